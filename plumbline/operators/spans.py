"""Interval joins between tokens, sentences and labelled spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Adds label: 1 if a span of the same key overlaps the token.

    The spans of a key travel as one array, so the token side is read once and no pair is kept."""
    held = spans.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    hit = F.exists("__spans", lambda s: (F.col("start") < s["end"]) & (F.col("end") > s["start"]))
    return tokens.join(held, key, "left").withColumn("label", F.coalesce(hit.cast("int"), F.lit(0))).drop("__spans")


def overlapping(left: DataFrame, right: DataFrame, key: str, *, share: float = 0.0) -> DataFrame:
    """Rows of left that a span of right of the same key overlaps (by more than nothing, and `share` of the shorter one at least)."""
    r = right.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    both = F.least("end", "__e") - F.greatest("start", "__s")
    shorter = F.least(F.col("end") - F.col("start"), F.col("__e") - F.col("__s"))
    return left.join(r, (F.col(key) == F.col("__k")) & (both > 0) & (both >= share * shorter), "left_semi")


def unsupported(tokens: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of tokens without a row of known with the same keys."""
    return tokens.join(known.select(*keys).distinct(), keys, "left_anti")


def containment(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(n, contained): gold spans, and the share of them that lie within one predicted span."""
    held = predicted.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("__p"))
    hit = F.exists("__p", lambda p: (p["start"] <= F.col("start")) & (p["end"] >= F.col("end")))
    return gold.join(held, key, "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("contained"))
