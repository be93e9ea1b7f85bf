"""Spans and tokens of a verification shaped for its output: clauses, merging, filters, shares, verdict rules, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import normalize as nm
from plumbline.functions import text as tx

#: What parts clauses: signs, a dash, words between blanks.
CLAUSE = rf"[{lex.CLAUSE_SIGNS}]|—|\s(?:{lex.CLAUSE_WORDS})\s"
PIECE = rf"{CLAUSE}|-|[^{lex.CLAUSE_SIGNS}—\s-]+|[\s\S]"
SPAN = "pair_id string, start int, end int, text string, risk double, label string, n_tokens long, source string"
STRIPPED = " \t\r\n,;:()[]{}«»\"“”"


def label_of(risk: Column) -> Column:
    return F.when(risk >= lex.LABEL_RISK, "likely_hallucination").otherwise("doubtful")


def in_sentences(spans: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds s_start and s_end: the sentence of the answer in which a span starts; the span itself if none does."""
    found = tx.sentences(answers, ["pair_id"], "answer").select(F.col("pair_id").alias("of"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    hit = (F.col("pair_id") == F.col("of")) & (F.col("s_start") <= F.col("start")) & (F.col("start") < F.col("s_end"))
    out = spans.join(found, hit, "left").drop("of")
    return out.withColumn("s_start", F.coalesce("s_start", "start")).withColumn("s_end", F.greatest(F.coalesce("s_end", "end"), F.col("end")))


def clause_breaks(answers: DataFrame) -> DataFrame:
    """(pair_id, b_start, b_end): where clauses are parted, by sentence."""
    rows = tx.sentences(answers.select("pair_id", "answer"), ["pair_id"], "answer").withColumnRenamed("idx", "sentence").withColumn("lead", F.col("start"))
    rows = rows.select("pair_id", "sentence", F.col("text").alias("whole"), F.col("lead").alias("base"))
    parts = tx.placed(rows, ["pair_id", "sentence", "whole", "base"], F.regexp_extract_all("whole", F.lit(f"(?iU)({PIECE})"), F.lit(1)), F.lit(0))
    beside = lambda at: F.substring("whole", at, F.lit(1)).rlike(r"(?U)^\s$")
    dash = (F.col("text") == "-") & beside(F.col("start")) & beside(F.col("end") + 1)
    parts = parts.where(F.when(F.col("text") == "-", dash).otherwise(F.col("text").rlike(f"(?iU)^(?:{CLAUSE})$")))
    return parts.select("pair_id", (F.col("base") + F.col("start")).alias("b_start"), (F.col("base") + F.col("end")).alias("b_end"))


def clauses(spans: DataFrame, answers: DataFrame) -> DataFrame:
    """spans (pair_id, start, end, keep_start, keep_end, more) with start and end moved to the clause that holds what is kept.

    Breaks are looked for in the sentence in which the span starts; where nothing but
    signs would be left, the sentence is the clause."""
    rows = in_sentences(spans, answers)
    breaks = clause_breaks(answers)
    # Ends hang on these columns alone; a generated id would change when the rows are computed again for the other side of the join.
    key = ["pair_id", "s_start", "s_end", "keep_start", "keep_end"]
    near = rows.select(*key).distinct().join(breaks, "pair_id").where((F.col("b_start") >= F.col("s_start")) & (F.col("b_end") <= F.col("s_end")))
    ends = near.groupBy(*key).agg(F.max(F.when(F.col("b_end") <= F.col("keep_start"), F.col("b_end"))).alias("l"), F.min(F.when(F.col("b_start") >= F.col("keep_end"), F.col("b_start"))).alias("r"))
    rows = rows.join(ends, key, "left").join(answers.select("pair_id", "answer"), "pair_id")
    left = F.greatest(F.col("s_start"), F.least(F.coalesce("l", "s_start"), F.col("keep_start")))
    right = F.least(F.col("s_end"), F.greatest(F.coalesce("r", "s_end"), F.col("keep_end")))
    rows = rows.withColumn("left", left).withColumn("right", right)
    bare = F.btrim(F.substring("answer", F.col("left") + 1, F.col("right") - F.col("left")), F.lit(STRIPPED)) == ""
    whole = (F.col("right") <= F.col("left")) | bare
    rows = rows.withColumn("start", F.when(whole, F.col("s_start")).otherwise(F.col("left")).cast("int")).withColumn("end", F.when(whole, F.col("s_end")).otherwise(F.col("right")).cast("int"))
    return rows.drop("s_start", "s_end", "l", "r", "left", "right", "answer")


def with_text(spans: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds the text of a span; blank spans go."""
    rows = spans.join(answers.select("pair_id", "answer"), "pair_id")
    rows = rows.withColumn("text", F.substring("answer", F.col("start") + 1, F.col("end") - F.col("start"))).drop("answer")
    return rows.where(F.btrim("text", F.lit(tx.BLANKS)) != "")


def mask_groups(rows: DataFrame) -> DataFrame:
    """(pair_id, keep_start, keep_end, before, after, risk, n_tokens): runs of neighbouring flagged tokens of rows (pair_id, idx, start, end, smooth, flagged).

    before and after are the ends of a run with the token next to it on either side."""
    pair = W.partitionBy("pair_id").orderBy("idx")
    rows = rows.withColumn("lag_start", F.lag("start").over(pair)).withColumn("lead_end", F.lead("end").over(pair)).where("flagged")
    rows = rows.withColumn("island", F.col("idx") - F.row_number().over(pair))
    edges = [F.min("start").alias("keep_start"), F.max("end").alias("keep_end"), F.min_by(F.coalesce("lag_start", "start"), "idx").alias("before"), F.max_by(F.coalesce("lead_end", "end"), "idx").alias("after")]
    return rows.groupBy("pair_id", "island").agg(*edges, F.max("smooth").alias("risk"), F.count(F.lit(1)).alias("n_tokens")).drop("island")


def capped(rows: DataFrame) -> DataFrame:
    """Spans of more than 40 characters and twice what is kept are cut to that width around the middle of what is kept."""
    most = F.greatest(F.lit(40), 2 * (F.col("keep_end") - F.col("keep_start")))
    middle = F.floor((F.col("keep_start") + F.col("keep_end")) / 2)
    left = F.greatest(F.col("start"), middle - F.floor(most / 2))
    wide = F.col("end") - F.col("start") > most
    right = F.least(F.col("end"), left + most)
    start = F.when(wide, F.least(left, F.col("keep_start"))).otherwise(F.col("start")).cast("int")
    return rows.withColumns({"start": start, "end": F.when(wide, F.greatest(right, F.col("keep_end"))).otherwise(F.col("end")).cast("int")})


def expanded(groups: DataFrame, answers: DataFrame, how: str = "clause") -> DataFrame:
    """Mask spans of SPAN from mask_groups: as flagged (mask), with a token more on each side (mask_padded), to the clause, or to a clause of bounded width (clause_capped)."""
    if how == "mask":
        rows = groups.withColumn("start", F.col("keep_start")).withColumn("end", F.col("keep_end"))
    elif how == "mask_padded":
        rows = groups.withColumn("start", F.col("before")).withColumn("end", F.col("after"))
    elif how in ("clause", "clause_capped"):
        rows = clauses(groups.withColumn("start", F.col("keep_start")).withColumn("end", F.col("keep_end")), answers)
    else:
        raise ValueError(f"unknown expansion: {how!r}")
    if how == "clause_capped":
        rows = capped(rows)
    rows = with_text(rows, answers)
    return rows.select("pair_id", "start", "end", "text", "risk", label_of(F.col("risk")).alias("label"), "n_tokens", F.lit("mask").alias("source"))


def merged(spans: DataFrame) -> DataFrame:
    """Spans of SPAN that meet become one: the first's text, the largest risk, all tokens, and the source rule if theirs differ."""
    order = W.partitionBy("pair_id").orderBy("start", "end", "source")
    rows = spans.withColumn("reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    likely = F.max(F.col("label") == "likely_hallucination")
    out = rows.groupBy("pair_id", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("text", F.struct("start", "end", "source")).alias("text"), F.max("risk").alias("risk"),
        F.when(likely, "likely_hallucination").otherwise("doubtful").alias("label"), F.sum("n_tokens").alias("n_tokens"), F.when(F.count_distinct("source") > 1, "rule").otherwise(F.first("source")).alias("source"))
    return out.drop("part")


def without_short(spans: DataFrame, least: int) -> DataFrame:
    """Spans of at least so many characters, and shorter ones with a number."""
    return spans.where((F.length(F.btrim("text", F.lit(tx.BLANKS))) >= least) | nm.has_number(F.col("text")))


def attribution_spans(found: DataFrame, risks: DataFrame, limits: DataFrame, answers: DataFrame) -> DataFrame:
    """Spans of SPAN around numbers (pair_id, start, end) that belong to another subject; at least the threshold is their risk."""
    inside = (F.col("t.start") >= F.col("f.start")) & (F.col("t.end") <= F.col("f.end")) & (F.col("t.pair_id") == F.col("f.pair_id"))
    own = found.select("pair_id", "start", "end").alias("f").join(risks.select("pair_id", "start", "end", "smooth").alias("t"), inside, "left")
    own = own.groupBy(F.col("f.pair_id").alias("pair_id"), F.col("f.start").alias("keep_start"), F.col("f.end").alias("keep_end")).agg(F.max("smooth").alias("top"), F.count("smooth").alias("n_tokens"))
    own = own.join(limits.select("pair_id", "span_threshold"), "pair_id").withColumn("risk", F.greatest(F.coalesce("top", "span_threshold"), F.col("span_threshold")))
    rows = with_text(clauses(own.withColumn("start", F.col("keep_start")).withColumn("end", F.col("keep_end")), answers), answers)
    return rows.select("pair_id", "start", "end", "text", "risk", label_of(F.col("risk")).alias("label"), "n_tokens", F.lit("attribution").alias("source"))


def coverage_spans(covered: DataFrame, limits: DataFrame, answers: DataFrame) -> DataFrame:
    """Spans of SPAN where the answer omits, distorts or tells only in part a fact of the context: the clause of the fact's subject."""
    rows = covered.where("status in ('omitted', 'partial', 'distorted') and answer_start >= 0 and answer_end > answer_start").join(limits.select("pair_id", "span_threshold"), "pair_id")
    has = (F.col("subject_start") >= 0) & (F.col("subject_end") > F.col("subject_start"))
    rows = rows.select("pair_id", "status", "span_threshold", F.col("answer_start").alias("start"), F.col("answer_end").alias("end"), F.when(has, F.col("subject_start")).otherwise(F.col("answer_start")).alias("keep_start"), F.when(has, F.col("subject_end")).otherwise(F.col("answer_end")).alias("keep_end"))
    rows = with_text(clauses(rows, answers), answers).withColumn("text", F.btrim("text", F.lit(tx.BLANKS)))
    risk = F.least(F.lit(1.0), F.col("span_threshold") + F.when(F.col("status") == "distorted", 0.15).otherwise(0.1))
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).cast("long")
    return rows.select("pair_id", "start", "end", "text", risk.alias("risk"), label_of(risk).alias("label"), words.alias("n_tokens"), F.lit("coverage").alias("source"))


def shares(risks: DataFrame, spans: DataFrame) -> DataFrame:
    """(pair_id, ai_share_soft, ai_share_hard) from scored tokens (pair_id, start, smooth, span_threshold): tokens that start in a span count in full.

    The others count with their risk in the soft share, and in the hard one if they reach the threshold."""
    toks = risks.where("scored").select("pair_id", "idx", "start", "smooth", "span_threshold")
    held = spans.select(F.col("pair_id").alias("of"), F.col("start").alias("s"), F.col("end").alias("e"))
    within = (F.col("pair_id") == F.col("of")) & (F.col("s") <= F.col("start")) & (F.col("start") < F.col("e"))
    inside = toks.join(held, within, "left_semi").select("pair_id", "idx", F.lit(True).alias("inside"))
    rows = toks.join(inside, ["pair_id", "idx"], "left")
    soft = F.avg(F.when(F.col("inside"), 1.0).otherwise(F.col("smooth")))
    hard = F.avg(F.when(F.col("inside") | (F.col("smooth") >= F.col("span_threshold")), 1.0).otherwise(0.0))
    return rows.groupBy("pair_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), soft)).alias("ai_share_soft"), hard.alias("ai_share_hard"))


#: The frozen parameters of the rule corroborated.
VERDICT = {"min_mask_tokens": lex.MIN_MASK_TOKENS, "min_fragment_chars": lex.MIN_FRAGMENT_CHARS, "min_flagged_share": 0.0, "text_rule_decisive": True}


def evidence(spans: DataFrame) -> DataFrame:
    """(pair_id, spans_total, mask_spans, mask_tokens, max_fragment_chars, text_spans) of spans of SPAN."""
    mask = F.col("source") == "mask"
    return spans.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("spans_total"), F.count_if(mask).alias("mask_spans"), F.coalesce(F.sum(F.when(mask, F.col("n_tokens"))), F.lit(0)).alias("mask_tokens"),
        F.coalesce(F.max(F.when(mask, F.length("text"))), F.lit(0)).alias("max_fragment_chars"), F.count_if(~mask).alias("text_spans"))


def is_doubted(rule: str = "corroborated", params: dict | None = None) -> Column:
    """Whether the evidence columns (score, threshold, spans_total, mask_tokens, max_fragment_chars, text_spans, scored_tokens) make an answer doubtful or worse."""
    over = F.col("score") >= F.col("threshold")
    if rule == "any_span":
        return over | (F.col("spans_total") > 0)
    if rule == "min_two_tokens":
        return over | (F.col("text_spans") > 0) | (F.col("mask_tokens") >= 2)
    if rule != "corroborated":
        raise ValueError(f"unknown rule: {rule!r}")
    p = {**VERDICT, **(params or {})}
    share = F.when(F.col("scored_tokens") > 0, F.col("mask_tokens") / F.col("scored_tokens")).otherwise(0.0)
    strong = (F.col("mask_tokens") >= p["min_mask_tokens"]) & (F.col("max_fragment_chars") >= p["min_fragment_chars"]) & (share >= p["min_flagged_share"]) & (F.col("mask_spans") > 0)
    return over | ((F.col("text_spans") > 0) & F.lit(p["text_rule_decisive"])) | strong


def verdict(rule: str = "corroborated", params: dict | None = None) -> Column:
    return F.when(F.col("score") >= F.col("threshold"), "likely_hallucination").when(is_doubted(rule, params), "doubtful").otherwise("grounded")


def token_payload(rows: DataFrame) -> DataFrame:
    """Tokens as the output lists them: features and risk to four places, the risk itself, flag and label."""
    label = F.when(F.col("flagged") & (F.col("smooth") >= lex.LABEL_RISK), "likely_hallucination").when(F.col("flagged"), "doubtful").otherwise("ok")
    return rows.select("pair_id", F.col("idx").alias("index"), F.btrim("text", F.lit(tx.BLANKS)).alias("text"), "start", "end", *(F.round(n, 4).alias(n) for n in lex.WEIGHTS), F.round("smooth", 4).alias("risk"), F.col("smooth").alias("raw_risk"), "flagged", label.alias("label"))


def feature_lists(features: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, a list of doubles for each working feature, in token order)."""
    held = features.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", *lex.WEIGHTS))).alias("rows"))
    return held.select(key, *(F.col("rows").getField(n).alias(n) for n in lex.WEIGHTS))
