"""Cosine similarity, nearest neighbours and local density of dense vectors."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of a hashed vector: the word itself, its trigrams, its neighbours.
OWN, GRAM, BESIDE = 1.0, 0.35, 0.25


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k rows nearest to each query, itself left out; both sides (vec_id, embedding).

    Exact. Queries go out in blocks; each task keeps its own best k per query, and those
    are ranked in a shuffle of k rows per query and task. Equal cosines: smaller id."""
    spark = rows.sparkSession
    asked = [(r["vec_id"], r["embedding"]) for r in queries.select("vec_id", "embedding").toLocalIterator()] if queries.count() <= block else None
    if asked is None:
        parts = -(-queries.count() // block)
        out = None
        for i in range(parts):
            part = nearest(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i), rows, k, block=1 << 31)
            out = part if out is None else out.unionAll(part)
        return out
    ids = np.array([i for i, _ in asked], np.int64)
    q = np.array([v for _, v in asked], np.float64) if asked else np.zeros((0, 1))
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    sent = spark.sparkContext.broadcast((ids, q / np.where(norm > 0, norm, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matrix = sent.value
        best_score = np.full((len(own), 0), 0.0)
        best_id = np.full((len(own), 0), 0, np.int64)
        for batch in batches:
            there = batch.column(0).to_numpy()
            v = np.array(batch.column(1).to_pylist(), np.float64)
            if not len(there) or not len(own):
                continue
            size = np.linalg.norm(v, axis=1, keepdims=True)
            score = np.round(matrix @ (v / np.where(size > 0, size, 1)).T, 9)
            score[own[:, None] == there[None, :]] = -np.inf
            score, at = np.concatenate([best_score, score], axis=1), np.concatenate([best_id, np.broadcast_to(there, score.shape)], axis=1)
            order = np.lexsort((at, -score), axis=1)[:, :k]
            best_score, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)
        keep = np.isfinite(best_score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, best_score.shape[1])[keep.ravel()]), pa.array(best_id[keep]), pa.array(best_score[keep])], ["query_id", "vec_id", "cosine"])

    found = rows.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null").mapInArrow(run, "query_id long, vec_id long, cosine double")
    w = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def density(neighbours: DataFrame) -> DataFrame:
    """(query_id, density): mean cosine of the neighbours."""
    return neighbours.groupBy("query_id").agg(F.avg("cosine").alias("density"))


def hashed_index(feature: str, dim: int) -> int:
    """A feature's place in a hashed vector, the same on every machine."""
    return int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "big") % dim


def hashed(word: str, before: str | None, after: str | None, dim: int) -> dict[int, float]:
    """The word, its character trigrams and its neighbours as a sparse vector of length one."""
    plain = lambda w: w.lower().replace("ё", "е")
    padded = f"^{plain(word)}$"
    grams = [padded[i : i + 3] for i in range(max(1, len(padded) - 2))]
    out: dict[int, float] = {}
    parts = [("w:" + plain(word), OWN)] + [("g:" + g, GRAM / len(grams) ** 0.5) for g in grams] + [(p + plain(w), BESIDE) for p, w in (("p:", before), ("n:", after)) if w]
    for name, weight in parts:
        at = hashed_index(name, dim)
        out[at] = out.get(at, 0.0) + weight
    norm = sum(v * v for v in out.values()) ** 0.5
    return {k: v / norm for k, v in out.items()}


def hashed_vectors(words: DataFrame, key: str, order: str, dim: int = 4096) -> DataFrame:
    """words (key, order, word) with vector, a map of place to weight."""
    w = W.partitionBy(key).orderBy(order)
    rows = words.withColumn("w_before", F.lag("word").over(w)).withColumn("w_after", F.lead("word").over(w))

    @F.pandas_udf("map<int,double>")
    def build(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([hashed(x, y, z, dim) for x, y, z in zip(a, b, c, strict=True)])

    return rows.withColumn("vector", build("word", "w_before", "w_after")).drop("w_before", "w_after")


def sparse_cosine(a: Column, b: Column) -> Column:
    """The product of two vectors of length one given as maps."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(both, F.lit(0.0), lambda n, k: n + F.element_at(a, k) * F.element_at(b, k))
