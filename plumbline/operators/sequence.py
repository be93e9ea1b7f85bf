"""Operators over ordered rows: smoothing, imputation, islands, interval merging, neighbour features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def smoothed(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Adds the mean of a value (weight 0.6) and its neighbours (0.2 each), renormalised at the ends; under three rows the value itself."""
    w = W.partitionBy(key).orderBy(order)
    left, right = F.lag(value).over(w), F.lead(value).over(w)
    total = 0.6 * F.col(value) + 0.2 * F.coalesce(left, F.lit(0.0)) + 0.2 * F.coalesce(right, F.lit(0.0))
    weight = F.lit(0.6) + F.when(left.isNotNull(), 0.2).otherwise(0.0) + F.when(right.isNotNull(), 0.2).otherwise(0.0)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return rows.withColumn(name, F.when(n < 3, F.col(value)).otherwise(total / weight))


def moving_average(rows: DataFrame, key: str, order: str, value: str, window: int, name: str) -> DataFrame:
    """Adds the centred mean over `window` rows, cut at the ends; under three rows the value itself."""
    half = window // 2
    w = W.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return rows.withColumn(name, F.when((n < 3) | F.lit(window <= 1), F.col(value)).otherwise(F.avg(value).over(w)))


def imputed(rows: DataFrame, key: str, order: str, value: str, informative: Column, window: int, name: str) -> DataFrame:
    """Adds the value, replaced where it isn't informative by the mean of the informative ones within `window` rows (if any)."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-window, window)
    return rows.withColumn(name, F.when(informative, F.col(value)).otherwise(F.coalesce(F.avg(F.when(informative, F.col(value))).over(w), F.col(value))))


def islands(rows: DataFrame, key: str, index: str, gap: int = 1) -> DataFrame:
    """Adds island, a number for each run of rows whose index grows by `gap` at most; rows are those that belong to runs."""
    w = W.partitionBy(key).orderBy(index)
    step = F.col(index) - F.lag(index).over(w)
    return rows.withColumn("__new", F.when(step <= gap, 0).otherwise(1)).withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__new")


def merged(spans: DataFrame, keys: list[str], join_gap: int = 0, extra: list[Column] | None = None) -> DataFrame:
    """(keys..., start, end, parts, extra...): intervals that overlap, touch or are join_gap apart become one."""
    before = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    new = F.when(F.col("start") <= F.max("end").over(before) + join_gap, 0).otherwise(1)
    running = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = spans.withColumn("__new", new).withColumn("__run", F.sum("__new").over(running))
    return runs.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts"), *(extra or [])).drop("__run")


def hysteresis(rows: DataFrame, key: str, index: str, risk: str, scored: str, *, low: float, high: float, bridge: int, least: int) -> DataFrame:
    """Rows kept by a two-level decoder, with their component.

    Scored rows of risk >= low form components. Up to `bridge` unscored rows between two
    of them don't part them, a scored row below low does. A component stays if it has at
    least `least` rows of risk >= high."""
    w = W.partitionBy(key).orderBy(index)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__low", F.sum(F.when(F.col(scored) & (F.col(risk) < low), 1).otherwise(0)).over(upto))
    grown = rows.where(F.col(scored) & (F.col(risk) >= low))
    split = (F.col(index) - F.lag(index).over(w) > bridge + 1) | (F.col("__low") != F.lag("__low").over(w))
    grown = grown.withColumn("__new", F.when(split, 1).otherwise(0)).withColumn("component", F.sum("__new").over(upto))
    strong = F.sum(F.when(F.col(risk) >= high, 1).otherwise(0)).over(W.partitionBy(key, "component"))
    return grown.withColumn("__strong", strong).where(F.col("__strong") >= least).drop("__low", "__new", "__strong")


def neighbour_features(rows: DataFrame, key: str, order: str, bases: list[str], k: int) -> DataFrame:
    """Adds for each base and distance d up to k: previous, next, left and right maxima, neighbour mean and difference to it; ends repeat themselves."""
    w = W.partitionBy(key).orderBy(order)
    first = {b: F.first_value(b).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for b in bases}
    last = {b: F.last_value(b).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for b in bases}
    out = {}
    for b in bases:
        left = {d: F.coalesce(F.lag(b, d).over(w), first[b]) for d in range(1, k + 1)}
        right = {d: F.coalesce(F.lead(b, d).over(w), last[b]) for d in range(1, k + 1)}
        for d in range(1, k + 1):
            out[f"{b}_previous_{d}"], out[f"{b}_next_{d}"] = left[d], right[d]
        lefts, rights = list(left.values()), list(right.values())
        out[f"{b}_left_max"] = F.greatest(*lefts) if k > 1 else lefts[0]
        out[f"{b}_right_max"] = F.greatest(*rights) if k > 1 else rights[0]
        out[f"{b}_mean"] = sum(lefts[1:] + rights, lefts[0]) / (2 * k)
        out[f"{b}_minus_mean"] = F.col(b) - out[f"{b}_mean"]
    return rows.withColumns(out)
