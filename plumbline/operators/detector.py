"""Style detector without a context: how predictable and how uniform the words of a text are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx
from plumbline.operators import sequence as sq

# Weights, threshold, smoothing and least sizes of the detector.
PREDICTABILITY, DENSITY, DENSITY_LEVEL = 0.7, 0.3, 0.35
SMOOTHING, LEAST_TOKENS, MERGE_GAP, NEIGHBOURS, THRESHOLD = 7, 6, 6, 5, 0.4663
# End of fixed values.


def signals(documents: DataFrame, key: str, column: str, window: int = 12) -> DataFrame:
    """Word tokens with predictability (set words, phrases, repetition and even lengths around) and density (likeness of neighbouring words)."""
    words = tx.tokens(documents, [key], column).where(F.col("text").rlike(r"^[\p{L}\p{N}_]")).withColumn("word", tx.plain(F.col("text")))
    words = words.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("idx")))
    near = W.partitionBy(key).orderBy("pos").rowsBetween(-window, window)
    before = W.partitionBy(key, "word").orderBy("pos")
    spread = F.coalesce(F.stddev_pop(F.length("word")).over(near), F.lit(0.0)) / F.greatest(F.lit(1.0), F.avg(F.length("word")).over(near))
    fixed = F.col("word").isin([w.replace("ё", "е") for w in lex.BOILERPLATE]).cast("double")
    again = (F.col("pos") - F.lag("pos").over(before) <= window).cast("double")
    even = F.greatest(F.lit(0.0), 1 - spread)
    predictable = F.least(F.lit(1.0), 0.5 * fixed + 0.2 * F.coalesce(again, F.lit(0.0)) + 0.3 * even)
    w = W.partitionBy(key).orderBy("pos")
    rows = words.withColumn("grams", tx.grams(F.col("word")))
    likes = [F.coalesce(tx.jaccard(F.col("grams"), f("grams", d).over(w)), F.lit(0.0)) for d in range(1, NEIGHBOURS + 1) for f in (F.lag, F.lead)]
    best = F.slice(F.sort_array(F.array(*likes), asc=False), 1, NEIGHBOURS)
    density = F.aggregate(best, F.lit(0.0), lambda a, b: a + b) / NEIGHBOURS
    return rows.withColumn("predictability", predictable).withColumn("density", F.least(F.lit(1.0), density / DENSITY_LEVEL)).drop("grams")


def probabilities(documents: DataFrame, key: str, column: str) -> DataFrame:
    """signals with probability: their weighted sum, smoothed over SMOOTHING words."""
    rows = signals(documents, key, column).withColumn("raw", PREDICTABILITY * F.col("predictability") + DENSITY * F.col("density"))
    return sq.moving_average(rows, key, "pos", "raw", SMOOTHING, "probability").drop("raw")


def spans(rows: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, start, end, n_tokens, mean, peak): runs of words at or above the threshold, close runs joined, short ones dropped."""
    runs = sq.islands(rows.where(F.col("probability") >= threshold), key, "pos", MERGE_GAP + 1)
    out = runs.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_tokens"), F.avg("probability").alias("mean"), F.max("probability").alias("peak"))
    return out.where(F.col("n_tokens") >= LEAST_TOKENS).drop("island")


def analyze(documents: DataFrame, key: str, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, score, share, n_spans): mean probability, and the share of words in spans."""
    rows = probabilities(documents, key, column)
    found = spans(rows, key, threshold).groupBy(key).agg(F.count(F.lit(1)).alias("n_spans"), F.sum("n_tokens").alias("in_spans"))
    all_ = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_words"), F.avg("probability").alias("score"))
    return all_.join(found, key, "left").select(key, "n_words", "score", (F.coalesce("in_spans", F.lit(0)) / F.col("n_words")).alias("share"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
