"""From pairs to verdicts: features, risk, threshold, spans, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx
from plumbline.operators import coverage as cv
from plumbline.operators import features as ft
from plumbline.operators import sequence as sq
from plumbline.operators import shaping as sh
from plumbline.scratch import written


def token_risks(pairs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Answer tokens with features, risk, and risk smoothed with unscored tokens as 0; rounded to 12 places, so that equal risks are equal."""
    rows = ft.combined(ft.token_features(pairs), weights).withColumn("base", F.when(F.col("scored"), F.col("risk")).otherwise(0.0))
    return sq.smoothed(rows, "pair_id", "idx", "base", "smooth").withColumn("smooth", F.round("smooth", 12)).drop("base")


def thresholds(risks: DataFrame, z: float = lex.SPAN_Z, floor: float = lex.SPAN_FLOOR, cap: float = lex.SPAN_CAP) -> DataFrame:
    """(pair_id, n_scored, span_threshold): median + z * 1.4826 * median deviation of the scored risks, within floor and cap."""
    return spanned(risks, z, floor, cap).where("scored").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_scored"), F.max("span_threshold").alias("span_threshold"))


def mask_spans(rows: DataFrame) -> DataFrame:
    """(pair_id, start, end, risk, n_tokens, n_chars) of spanned() tokens: runs of neighbouring flagged ones, without the blanks at their end."""
    out = rows.where("flagged").groupBy("pair_id", "island").agg(F.min("start").alias("start"), F.max("island_chars").alias("n_chars"), F.max("smooth").alias("risk"), F.count(F.lit(1)).alias("n_tokens"))
    return out.select("pair_id", "start", (F.col("start") + F.col("n_chars")).cast("int").alias("end"), "risk", "n_tokens", "n_chars")


def score_of(risks: Column) -> Column:
    """Half the mean and half the mean of the top fifth of risks in falling order; 0 without any."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    top = F.slice(risks, 1, F.greatest(F.lit(1), F.floor(F.size(risks) * lex.TOP_SHARE + 1e-9).cast("int")))
    return F.when(F.size(risks) > 0, 0.5 * mean(risks) + 0.5 * mean(top)).otherwise(0.0)


def answer_scores(risks: DataFrame) -> DataFrame:
    """(pair_id, score) by score_of the scored risks."""
    held = risks.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("scored"), F.col("smooth"))), asc=False).alias("v"))
    return held.select("pair_id", score_of(F.col("v")).alias("score"))


def spanned(risks: DataFrame, z: float = lex.SPAN_Z, floor: float = lex.SPAN_FLOOR, cap: float = lex.SPAN_CAP) -> DataFrame:
    """risks with span_threshold, flagged, island and island_chars, as windows over each pair.

    All windows are by pair, like the smoothing before them, so tokens are shuffled once for all of it."""
    pair = W.partitionBy("pair_id")
    rows = risks.withColumn("__s", F.when(F.col("scored"), F.col("smooth")))
    rows = rows.withColumn("__m", F.median("__s").over(pair))
    rows = rows.withColumn("__d", F.median(F.abs(F.col("__s") - F.col("__m"))).over(pair))
    value = F.greatest(F.lit(0.0), F.least(F.lit(min(0.999, cap)), F.greatest(F.col("__m") + z * 1.4826 * F.col("__d"), F.lit(floor))))
    rows = rows.withColumn("span_threshold", F.round(F.coalesce(value, F.lit(1.0)), 12)).withColumn("flagged", F.col("scored") & (F.col("smooth") >= F.col("span_threshold")))
    rows = rows.withColumn("island", F.when(F.col("flagged"), F.col("idx") - F.sum(F.col("flagged").cast("int")).over(pair.orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow))))
    each = W.partitionBy("pair_id", "island")
    bare = F.col("start") + F.length(F.rtrim(F.col("text"), F.lit(tx.BLANKS)))
    return rows.withColumn("island_chars", F.when(F.col("flagged"), F.max(bare).over(each) - F.min("start").over(each))).drop("__s", "__m", "__d")


def verify(pairs: DataFrame, threshold: float = lex.THRESHOLD) -> DataFrame:
    """One row per pair: n_tokens, n_scored, score, span_threshold, n_spans, mask_tokens, longest, ai_share_hard, n_borrowed, verdict.

    verdict: empty without tokens, likely_hallucination from the threshold on, doubtful if
    a number belongs to another subject or the mask has enough tokens in a long enough
    span, else grounded."""
    held = spanned(token_risks(pairs)).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_if("scored").alias("n_scored"), F.max("span_threshold").alias("span_threshold"),
        F.sort_array(F.collect_list(F.when(F.col("scored"), F.col("smooth"))), asc=False).alias("v"),
        F.count_distinct("island").alias("n_spans"), F.count_if("flagged").alias("mask_tokens"), F.max("island_chars").alias("longest"), F.count_if("borrowed").alias("n_borrowed"),
    )
    held = held.withColumn("score", score_of(F.col("v"))).drop("v")
    rows = pairs.select("pair_id").join(held, "pair_id", "left")
    rows = rows.fillna(0, ["n_tokens", "n_scored", "n_spans", "mask_tokens", "longest", "n_borrowed", "score"]).fillna(1.0, ["span_threshold"])
    share = F.when(F.col("n_scored") > 0, F.col("mask_tokens") / F.col("n_scored")).otherwise(0.0)
    strong = (F.col("mask_tokens") >= lex.MIN_MASK_TOKENS) & (F.col("longest") >= lex.MIN_FRAGMENT_CHARS)
    verdict = F.when(F.col("n_tokens") == 0, "empty").when(F.col("score") >= threshold, "likely_hallucination").when((F.col("n_borrowed") > 0) | strong, "doubtful").otherwise("grounded")
    return rows.withColumn("ai_share_hard", share).withColumn("verdict", verdict)


def result_spans(pairs: DataFrame, rows: DataFrame, expansion: str = "clause", least_chars: int = 0, cover: bool = True) -> DataFrame:
    """Spans of sh.SPAN of the spanned() tokens: the mask's, those around numbers of other subjects, and those of facts that the answer leaves out or changes."""
    answers = pairs.select("pair_id", "answer")
    mask = sh.merged(sh.expanded(sh.mask_groups(rows), answers, expansion))
    if least_chars:
        mask = sh.without_short(mask, least_chars)
    limits = rows.groupBy("pair_id").agg(F.max("span_threshold").alias("span_threshold"))
    numbers = rows.where("borrowed").select("pair_id", "start", F.col("end"))
    text = sh.attribution_spans(numbers, rows, limits, answers)
    if cover:
        text = text.unionByName(sh.coverage_spans(written(cv.coverage(pairs), "facts"), limits, answers))
    return sh.merged(mask.unionByName(text))


def verified(pairs: DataFrame, *, threshold: float = lex.THRESHOLD, rule: str = "corroborated", params: dict | None = None, expansion: str = "clause", least_chars: int = 0, cover: bool = True) -> DataFrame:
    """One row per pair: n_tokens, n_scored, score, span_threshold, mean_risk, p90_risk, spans, ai_share_soft, ai_share_hard, is_hallucination, verdict.

    The verdict is empty without tokens, likely_hallucination from the threshold on, else
    doubtful if the rule finds the spans strong enough, or grounded. Tokens and spans are
    written once, as several parts of the result read them."""
    rows = written(spanned(token_risks(pairs)), "tokens")
    held = rows.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_if("scored").alias("n_scored"), F.max("span_threshold").alias("span_threshold"),
        F.sort_array(F.collect_list(F.when(F.col("scored"), F.col("smooth"))), asc=False).alias("v"))
    at = F.size("v") - F.least(F.size("v") - 1, F.greatest(F.lit(0), F.bround(F.lit(0.9) * F.size("v")).cast("int") - 1))
    p90 = F.when(F.size("v") > 0, F.element_at("v", F.greatest(F.lit(1), at))).otherwise(0.0)
    mean = F.when(F.size("v") > 0, F.aggregate("v", F.lit(0.0), lambda x, y: x + y) / F.size("v")).otherwise(0.0)
    held = held.select("pair_id", "n_tokens", "n_scored", "span_threshold", score_of(F.col("v")).alias("score"), F.round(mean, 4).alias("mean_risk"), F.round(p90, 4).alias("p90_risk"))
    spans = written(result_spans(pairs, rows, expansion, least_chars, cover), "spans")
    listed = spans.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text", "risk", "label", "n_tokens", "source"))).alias("spans"))
    out = pairs.select("pair_id").join(held, "pair_id", "left").join(sh.evidence(spans), "pair_id", "left").join(sh.shares(rows, spans), "pair_id", "left").join(listed, "pair_id", "left")
    out = out.fillna(1.0, ["span_threshold"]).fillna(0, [c for c in out.columns if c not in ("pair_id", "spans")])
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType))).withColumn("threshold", F.lit(threshold)).withColumn("scored_tokens", F.col("n_scored"))
    verdict = F.when(F.col("n_tokens") == 0, "empty").otherwise(sh.verdict(rule, params))
    out = out.withColumn("is_hallucination", F.col("score") >= threshold).withColumn("verdict", verdict)
    return out.select("pair_id", "n_tokens", "n_scored", "score", "span_threshold", "mean_risk", "p90_risk", "spans", "ai_share_soft", "ai_share_hard", "is_hallucination", "verdict")
