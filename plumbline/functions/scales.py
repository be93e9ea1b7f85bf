"""Scaled features: masses against what even attention would give, contrasts of similarities, distances, robust scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as DuckDB does it: the product with 10^digits, in doubles, to the nearest integer, halves away from zero.

    F.round goes by the shortest decimal that reads as the value, so that 57/800 gives 0.0713; the product is 712.4999999999999 and gives 0.0712."""
    scale = F.lit(10.0**digits)
    return F.round(value * scale, 0) / scale


def expected_mass(context_tokens: Column, position: Column) -> Column:
    """Share of context among the positions that a token sees."""
    seen = position + 1
    return F.when((seen <= 0) | (context_tokens <= 0), 0.0).otherwise(F.least(F.lit(1.0), context_tokens / seen))


def relative_mass(observed: Column, expected: Column, least: float = 1e-9) -> Column:
    """How many times the mass is what was expected; not bounded above."""
    return F.when(expected <= least, 0.0).otherwise(observed / expected)


def mass_lift(observed: Column, expected: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), observed - expected))


def contrast(best: Column, mean: Column) -> Column:
    """By how much the best similarity stands out from the mean (or from the second best: a margin)."""
    return best - mean


def relative_distance(distance: Column, length: Column) -> Column:
    """A distance as a share of a text's length."""
    return F.when(length <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), distance / (length - 1))))


def decayed(similarity: Column, distance: Column, scale: float) -> Column:
    """A similarity that falls with distance."""
    return similarity * F.exp(-F.abs(distance) / F.lit(float(scale))) if scale > 0 else F.lit(0.0)


def scaled(rows: DataFrame, key: str, value: str, to: str, quantile: float = 1.0) -> DataFrame:
    """Adds `to`: the value over the key's largest (or the value at a quantile's rank, halves to even), within [0, 1]."""
    by = W.partitionBy(key)
    top = F.max(value).over(by)
    if quantile < 1:
        rank = F.bround(F.lit(float(quantile)) * (F.count(value).over(by) - 1)).cast("int")
        at = F.row_number().over(by.orderBy(value)) - 1
        rows = rows.withColumn("at_rank", F.when(at == F.greatest(F.lit(0), rank), F.col(value)))
        top = F.max("at_rank").over(by)
    out = rows.withColumn("top_value", top)
    share = F.when(F.col("top_value") <= 1e-12, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(value) / F.col("top_value"))))
    return out.withColumn(to, share).drop("at_rank", "top_value")
