"""Quality of scores, spans and answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def confusion(rows: DataFrame, label: Column, flag: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn with precision, recall, f1, fpr and accuracy, for all rows or by keys."""
    count = lambda c: F.count_if(c)
    yes, said = label == 1, flag
    out = rows.groupBy(*(keys or [])).agg(count(yes & said).alias("tp"), count(~yes & said).alias("fp"), count(yes & ~said).alias("fn"), count(~yes & ~said).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(*(keys or []), tp, fp, fn, tn, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def by_score(rows: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, score, pos, neg): labels pre-aggregated by distinct score; what rank statistics need."""
    return rows.groupBy(*(keys or []), F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def auc(rows: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive scores higher, ties counting half; null if a class is missing.

    Rows are summed by score before they are ordered, so the ordered side has distinct scores only."""
    keys = keys or []
    held = by_score(rows, score, label, keys)
    w = W.partitionBy(*keys).orderBy("score") if keys else W.partitionBy(F.lit(0)).orderBy("score")
    below = F.coalesce(F.sum("neg").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2.0))
    out = held.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("wins").alias("wins"))
    return out.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def brier(rows: DataFrame, score: str, label: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def calibration_error(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width."""
    held = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("said"), F.avg(F.col(label).cast("double")).alias("was"))
    return held.agg((F.sum(F.col("n") * F.abs(F.col("said") - F.col("was"))) / F.sum("n")).alias("ece"), F.count(F.lit(1)).alias("bins"))


def threshold_curve(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tp, fp, fn, tn, f1, fpr) for every distinct score as threshold (score >= threshold is a flag)."""
    held = by_score(rows, score, label)
    w = W.partitionBy(F.lit(0)).orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(F.lit(0))
    out = held.select(F.col("score").alias("threshold"), F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("p") - F.col("tp"), F.col("n") - F.col("fp")
    return out.select("threshold", tp, fp, fn.alias("fn"), tn.alias("tn"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"))


def best_threshold(rows: DataFrame, score: str, label: str, max_fpr: float) -> DataFrame:
    """The threshold of best f1 with fpr within max_fpr (of equal ones the smaller fpr, then the larger threshold); without any, the best f1 of all."""
    curve = threshold_curve(rows, score, label).withColumn("constraint_met", F.col("fpr") <= max_fpr)
    return curve.orderBy(F.col("constraint_met").desc(), F.col("f1").desc(), "fpr", F.col("threshold").desc()).limit(1)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = overlap(s1, e1, s2, e2)
    return ratio(both, (e1 - s1) + (e2 - s2) - both)


def _matches(group: pd.DataFrame, least: float) -> tuple[int, int, int]:
    """(matched, predicted, gold): predictions in order each take the best free gold span of enough overlap."""
    said = group[group.kind == 0].sort_values(["start", "end"])[["start", "end"]].to_numpy()
    gold = group[group.kind == 1].sort_values(["start", "end"])[["start", "end"]].to_numpy()
    free, hit = np.ones(len(gold), bool), 0
    for s, e in said:
        both = np.maximum(0, np.minimum(e, gold[:, 1]) - np.maximum(s, gold[:, 0])) if len(gold) else np.zeros(0)
        share = np.where(free, both / np.maximum(1, (e - s) + (gold[:, 1] - gold[:, 0]) - both), -1) if len(gold) else both
        if len(gold) and share.max() >= least:
            free[share.argmax()] = False
            hit += 1
    return hit, len(said), len(gold)


def span_f1(predicted: DataFrame, gold: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Precision, recall and f1 of spans (key, start, end), matched greedily within a key by IoU.

    Matching depends on its own order, so it runs per key on that key's spans only."""
    rows = predicted.select(F.col(key).cast("string").alias("k"), "start", "end", F.lit(0).alias("kind")).unionAll(gold.select(F.col(key).cast("string").alias("k"), "start", "end", F.lit(1).alias("kind")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hit, said, there = _matches(group, least)
        return pd.DataFrame({"hit": [hit], "said": [said], "there": [there]})

    held = rows.groupBy("k").applyInPandas(run, "hit long, said long, there long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hit", "said", "there")))
    hit, said, there = F.col("hit"), F.col("said"), F.col("there")
    return held.select("hit", "said", "there", ratio(hit, said).alias("precision"), ratio(hit, there).alias("recall"), ratio(2 * hit, said + there).alias("f1"))


def gram_counts(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct character n-grams of a text as numbers, and how often each occurs; n is 3 at most, so that they fit 64 bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = codes[: len(codes) - n + 1]
    for i in range(1, n):
        grams = grams << np.uint64(21) | codes[i : len(codes) - n + 1 + i]
    return np.unique(grams, return_counts=True)


def rouge_n(rows: DataFrame, key: str, left: str, right: str, n: int) -> DataFrame:
    """(key, rouge): F-measure of shared character n-grams (n is 3 at most), counted with repeats.

    Two texts are counted and compared where they stand, so nothing is shuffled."""
    if not 1 <= n <= 3:
        raise ValueError("n-grams of one to three characters")

    @F.pandas_udf(T.DoubleType())
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            (gx, cx), (gy, cy) = gram_counts(x, n), gram_counts(y, n)
            _, i, j = np.intersect1d(gx, gy, assume_unique=True, return_indices=True)
            both = int(np.minimum(cx[i], cy[j]).sum())
            p, r = (both / cy.sum(), both / cx.sum()) if both else (0.0, 0.0)
            out.append(2 * p * r / (p + r) if both else 0.0)
        return pd.Series(out, dtype="float64")

    return rows.select(key, measure(left, right).alias("rouge"))


def rouge_l(left: pd.Series, right: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of characters (a pandas UDF's body)."""
    out = []
    for a, b in zip(left.fillna(""), right.fillna(""), strict=True):
        places: dict[str, int] = {}
        for i, c in enumerate(b):
            places[c] = places.get(c, 0) | 1 << i
        full = (1 << len(b)) - 1
        row = full
        for c in a:
            met = row & places.get(c, 0)
            row = ((row + met) | (row - met)) & full
        both = len(b) - row.bit_count()
        out.append(2 * both / (len(a) + len(b)) if both else 0.0)
    return pd.Series(out, dtype="float64")


def set_match(rows: DataFrame, predicted: str, reference: str) -> DataFrame:
    """(rows, accuracy, jaccard, hamming) of sets: equal sets, shared over all elements, and share of elements in one only; two empty sets agree."""
    both, all_ = F.size(F.array_intersect(predicted, reference)), F.size(F.array_union(predicted, reference))
    alike = F.when(all_ == 0, 1.0).otherwise(both / all_)
    equal = F.when(both == all_, 1.0).otherwise(0.0)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(equal).alias("accuracy"), F.avg(alike).alias("jaccard"), F.avg(1 - alike).alias("hamming"))


def gate(metrics: DataFrame, least_f1: float, most_fpr: float, name: str = "gate") -> DataFrame:
    """Adds whether f1 and fpr reach a gate."""
    missing = F.col("f1").isNull() | F.col("fpr").isNull()
    return metrics.withColumn(name, F.when(missing, "not measured").when((F.col("f1") >= least_f1) & (F.col("fpr") <= most_fpr), "reached").otherwise("not reached"))


def bootstrap_auc(rows: DataFrame, score: str, label: str, key: str, replicates: int = 5000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(replicates, low, high): percentile interval of the AUC over resamples of clusters.

    Every cluster gets a Poisson(1) weight per replicate from a hash of seed, replicate and
    key, so replicates are computed side by side and again the same."""
    held = by_score(rows, score, label, [key])
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("replicate"), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    cuts, p, total = [], float(np.exp(-1)), 0.0
    for i in range(12):
        total += p
        cuts.append(total)
        p /= i + 1
    weight = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
    spread = held.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("weight", weight).where("weight > 0")
    spread = spread.groupBy("replicate", "score").agg(F.sum(F.col("pos") * F.col("weight")).alias("pos"), F.sum(F.col("neg") * F.col("weight")).alias("neg"))
    w = W.partitionBy("replicate").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    spread = spread.withColumn("wins", F.col("pos") * (F.coalesce(F.sum("neg").over(w), F.lit(0)) + F.col("neg") / 2.0))
    each = spread.groupBy("replicate").agg(F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("auc")).where("auc is not null")
    side = (1 - level) / 2
    return each.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("auc", F.lit(side)).alias("low"), F.percentile("auc", F.lit(1 - side)).alias("high"))
