"""Candidate spans of a mask with the features that a filter judges them by, and spans merged without losing where they came from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.operators import heads
from plumbline.operators import sequence as sq
from plumbline.operators import shaping as sh


def checked_generator(low: float, high: float, bridge: int, least: int) -> dict:
    """The parameters of a generator, or an error."""
    if not (0 <= low <= high <= 1) or bridge not in (0, 1, 2) or least not in (1, 2):
        raise ValueError("a generator needs 0 <= low <= high <= 1, a bridge of 0 to 2 and 1 or 2 seeds")
    return {"low": low, "high": high, "bridge": bridge, "least": least}


def checked_decoder(low: float, high: float, bridge: int = 0, least: int = 1) -> dict:
    """The parameters of a decoder; cutoffs above any risk are allowed."""
    if not (math.isfinite(low) and math.isfinite(high) and 0 <= low <= high) or bridge not in (0, 1) or least not in (1, 2):
        raise ValueError("a decoder needs finite 0 <= low <= high, a bridge of 0 or 1 and 1 or 2 seeds")
    return {"low": low, "high": high, "bridge": bridge, "least": least}


def checked_filter(head: dict, keep: float) -> dict:
    """A linear head over SPAN_FEATURES, or an error."""
    n = len(lex.SPAN_FEATURES)
    for name in ("mean", "scale", "coef"):
        if len(head.get(name, ())) != n or not all(math.isfinite(x) for x in head[name]):
            raise ValueError(f"{name} must hold {n} finite numbers")
    if min(head["scale"]) <= 0 or not math.isfinite(head.get("intercept", math.nan)) or not 0 <= keep <= math.nextafter(1.0, 2.0):
        raise ValueError("scales must be positive, intercept and threshold finite")
    return {**head, "keep": keep}


def candidates(rows: DataFrame, answers: DataFrame, rules: DataFrame, low: float, high: float, bridge: int, least: int) -> DataFrame:
    """(pair_id, start, end, risk, SPAN_FEATURES...) of runs of scored tokens at or above low that hold enough seeds at or above high.

    rows: tokens (pair_id, idx, start, end, scored, smooth); answers (pair_id, answer,
    score); rules: spans (pair_id, start, end, source)."""
    checked_generator(low, high, bridge, least)
    scored = W.partitionBy("pair_id").orderBy("idx")
    toks = rows.where("scored").withColumn("before", F.lag("smooth").over(scored)).withColumn("after", F.lead("smooth").over(scored))
    kept = sq.hysteresis(toks, "pair_id", "idx", "smooth", "scored", low=low, high=high, bridge=bridge, least=least)
    inside = W.partitionBy("pair_id", "component").orderBy("idx")
    kept = kept.withColumn("gap", F.col("idx") - F.lag("idx").over(inside) - 1)
    v, first, last = F.col("smooth"), (lambda c: F.min_by(c, "idx")), (lambda c: F.max_by(c, "idx"))
    n = F.count(F.lit(1))
    held = kept.groupBy("pair_id", "component").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max(v).alias("risk"), n.alias("scored_count"), F.count_if(v >= high).alias("seed_count"), F.avg(v).alias("mean_risk"), F.min(v).alias("min_risk"), F.sum(v).alias("risk_mass"),
        (F.count_if(v >= low) / n).alias("low_fraction"), (F.count_if(v >= high) / n).alias("high_fraction"), (F.max("idx") - F.min("idx") + 1).alias("token_width"), F.count_if(F.col("gap") > 0).alias("bridged_gaps"), F.coalesce(F.sum("gap"), F.lit(0)).alias("bridged_tokens"),
        first(v - F.coalesce("before", "smooth")).alias("left_gradient"), last(v - F.coalesce("after", "smooth")).alias("right_gradient"))
    r = rules.select(F.col("pair_id").alias("of"), F.col("start").alias("s"), F.col("end").alias("e"), "source")
    met = held.select("pair_id", "component", "start", "end").join(r, (F.col("pair_id") == F.col("of")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")))
    tags = met.groupBy("pair_id", "component").agg(F.max((F.col("source") == "attribution").cast("int")).alias("exact"), F.lit(1).alias("tag"))
    held = held.join(tags, ["pair_id", "component"], "left").join(answers.select("pair_id", F.length("answer").alias("size"), "score"), "pair_id")
    whole = F.greatest(F.lit(1), F.col("size"))
    held = held.withColumns({"max_risk": F.col("risk"), "char_width": F.col("end") - F.col("start"), "exact_anchor": F.coalesce("exact", F.lit(0)), "rule_tag": F.coalesce("tag", F.lit(0)), "relative_start": F.col("start") / whole, "relative_end": F.col("end") / whole, "p1_calibrated_score": F.col("score")})
    return held.select("pair_id", "start", "end", "risk", "scored_count", *(F.col(c).cast("double").alias(c) for c in lex.SPAN_FEATURES if c != "scored_count")).withColumn("scored_count", F.col("scored_count").cast("double"))


def probability(head: dict) -> Column:
    """The head's probability of a candidate."""
    return heads.logistic(list(lex.SPAN_FEATURES), head["mean"], head["scale"], head["coef"], head["intercept"])


def filtered(found: DataFrame, head: dict, keep: float, rules: DataFrame, answers: DataFrame) -> DataFrame:
    """The candidates that the head keeps, merged with the rules' spans, which are never judged."""
    checked_filter(head, keep)
    kept = sh.with_text(found.where(probability(head) >= keep).select("pair_id", "start", "end", "risk", F.col("scored_count").cast("long").alias("n_tokens")), answers)
    kept = kept.select("pair_id", "start", "end", "text", "risk", sh.label_of(F.col("risk")).alias("label"), "n_tokens", F.lit("mask").alias("source"))
    return localized(kept.unionByName(rules.select(*kept.columns)), answers)


def localized(spans: DataFrame, answers: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Spans that meet become one with its text cut anew and all sources listed; n_tokens counted anew where tokens are given."""
    order = W.partitionBy("pair_id").orderBy("start", "end", "source")
    rows = spans.withColumn("reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = rows.groupBy("pair_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("risk").alias("risk"), F.sort_array(F.collect_set("source")).alias("sources"), F.sum("n_tokens").alias("n_tokens"), F.max(F.col("label") == "likely_hallucination").alias("likely")).drop("part")
    if tokens is not None:
        toks = tokens.select(F.col("pair_id").alias("of"), F.col("start").alias("s"), F.col("end").alias("e"))
        own = out.select("pair_id", "start", "end").join(toks, (F.col("pair_id") == F.col("of")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))).groupBy("pair_id", "start").agg(F.count(F.lit(1)).alias("own"))
        out = out.join(own, ["pair_id", "start"], "left").withColumn("n_tokens", F.coalesce("own", F.lit(0))).drop("own")
    out = sh.with_text(out, answers)
    source = F.when(F.size("sources") == 1, F.col("sources")[0]).otherwise("rule")
    return out.select("pair_id", "start", "end", "text", "risk", F.when(F.col("likely"), "likely_hallucination").otherwise("doubtful").alias("label"), "n_tokens", source.alias("source"), "sources")


def candidate_labels(found: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """found with label 1 where a candidate overlaps a gold span (pair_id, start, end) by at least `least` of their union."""
    g = gold.select(F.col("pair_id").alias("of"), F.col("start").alias("s"), F.col("end").alias("e"))
    both = F.greatest(F.lit(0), F.least("end", "e") - F.greatest("start", "s"))
    share = both / (F.col("end") - F.col("start") + F.col("e") - F.col("s") - both)
    best = found.select("pair_id", "start", "end").join(g, (F.col("pair_id") == F.col("of")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))).groupBy("pair_id", "start", "end").agg(F.max(share).alias("share"))
    return found.join(best, ["pair_id", "start", "end"], "left").withColumn("label", (F.coalesce("share", F.lit(0.0)) >= least).cast("int")).drop("share")
