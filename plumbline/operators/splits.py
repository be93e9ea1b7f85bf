"""Deterministic splits, samples and assignments by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_key(seed: str, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), value.cast("string")), 256)


def folds(rows: DataFrame, group: Column, n: int, seed: str = "42") -> DataFrame:
    """Adds fold: that of the row's group, so that a group is in one fold only; needs no shuffle."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(hash_key(seed, group), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))


def sample(rows: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """The n rows whose key comes first in hash order."""
    return rows.withColumn("__h", hash_key(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def ratio_split(rows: DataFrame, group: str, parts: dict[str, float], seed: str = "42") -> DataFrame:
    """Adds split: groups in hash order fill the parts one after the other by their share of the rows.

    Only groups and their counts are ordered, not rows."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(F.lit(0)).orderBy(hash_key(seed, F.col(group)), group)
    upto = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    share = upto / F.sum("n").over(W.partitionBy(F.lit(0)))
    names, total, choice = list(parts), 0.0, None
    for name in names[:-1]:
        total += parts[name]
        choice = F.when(share < total, name) if choice is None else choice.when(share < total, name)
    return rows.join(counts.select(group, choice.otherwise(names[-1]).alias("split")), group)


def ranked(rows: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """Adds rank: the place of a row, from 0, in hash order of the key (then the key).

    A task orders the rows of one bucket of hashes; the counts of the buckets before it
    give where they start, so no task orders all rows."""
    named = rows.withColumn("order_hash", hash_key(seed, F.col(key))).withColumn("order_bucket", F.substring("order_hash", 1, 3))
    sizes = named.groupBy("order_bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("order_bucket", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("order_bucket")) - F.col("n")).alias("start_rank"))  # 4096 buckets at most
    inside = F.row_number().over(W.partitionBy("order_bucket").orderBy("order_hash", key)) - 1
    return named.join(F.broadcast(starts), "order_bucket").withColumn("rank", F.col("start_rank") + inside).drop("order_hash", "order_bucket", "start_rank")


def round_robin(rows: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """Adds slot: 0..n-1 in turn, in hash order of the key."""
    return ranked(rows, key, seed).withColumn("slot", F.pmod("rank", F.lit(n)).cast("int")).drop("rank")


def shared_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that are in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
