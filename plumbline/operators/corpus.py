"""Building and describing corpora: distributions, balance, crawling rules, classification, keys and windows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as tx

POINTS = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}


def distribution(rows: DataFrame, value: Column, keys: list[str] | None = None) -> DataFrame:
    """Exact percentiles, linearly interpolated.

    Values are counted first, so a group sends each distinct value once."""
    held = rows.groupBy(*(keys or []), value.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null")
    points = F.percentile("v", F.array(*map(F.lit, POINTS.values())), F.col("n"))
    out = held.groupBy(*(keys or [])).agg(F.sum("n").alias("n"), points.alias("p"))
    return out.select(*(keys or []), "n", *(F.col("p")[i].alias(name) for i, name in enumerate(POINTS)))


def balance(rows: DataFrame, mode: str, modes: list[str], least: int) -> DataFrame:
    """(mode, n, share, enough) for each of the modes, those without rows too."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(m,) for m in modes], "mode string")
    counts = rows.groupBy(F.col(mode).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))  # over modes, not rows
    out = F.broadcast(wanted).join(counts, "mode", "left")
    return out.select("mode", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("n", F.lit(0)) >= least).alias("enough"))


def allowed(url: Column, disallowed: list[str]) -> Column:
    """May a URL be fetched? Its path must start with none of the prefixes; an empty prefix forbids nothing."""
    path = F.regexp_replace(url, r"^[a-z]+://[^/]*", "")
    path = F.when(path == "", "/").otherwise(path)
    out = F.lit(True)
    for prefix in disallowed:
        if prefix:
            out = out & ~F.startswith(path, F.lit(prefix))
    return out


def first_match(text: Column, rules: dict[str, str]) -> Column:
    """The name of the first regex that matches, in order; null if none does."""
    out = None
    for name, pattern in rules.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out


def tidy(text: Column) -> Column:
    """Blanks and line ends normalised: no soft hyphens, plain blanks, a single newline as a blank, blank lines kept."""
    out = F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("­"), F.lit("")), F.lit(" "), F.lit(" "))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n\n+", "\x01")
    return F.btrim(F.replace(F.replace(out, F.lit("\n"), F.lit(" ")), F.lit("\x01"), F.lit("\n\n")), F.lit(" \n"))


def cache_key(mode: Column, model: Column, length: int, answer: Column, context: Column) -> Column:
    """Key of a pair's features."""
    return F.sha2(F.concat_ws("|", mode, model, F.lit(str(length)), answer, context), 256)


def choice(options: list[str], key: Column) -> Column:
    """One of the options by the hash of a key."""
    at = F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(len(options))).cast("int")
    return F.get(F.array(*map(F.lit, options)), at)


def paired_difference(rows: DataFrame, key: str, label: str, value: str, high: str, low: str) -> DataFrame:
    """(key, difference): mean value of rows labelled high less that of rows labelled low, for keys that have both."""
    mean = lambda x: F.avg(F.when(F.col(label) == x, F.col(value)))
    return rows.groupBy(key).agg((mean(high) - mean(low)).alias("difference")).where("difference is not null")


def quoted_at(rows: DataFrame, text: str, part: str) -> DataFrame:
    """Adds place (offset of the first occurrence, null without) and times (occurrences without overlap)."""
    return rows.withColumns({"place": tx.first_place(F.col(text), F.col(part)), "times": tx.occurrences(F.col(text), F.col(part))})


def neighbourhood(sentences: DataFrame, key: str, most: int) -> DataFrame:
    """Adds around: a sentence with its neighbours, cut from the left to `most` characters."""
    w = W.partitionBy(key).orderBy("idx")
    whole = F.concat_ws("", F.lag("text").over(w), F.col("text"), F.lead("text").over(w))
    return sentences.withColumn("around", F.when(F.length(whole) > most, F.substring(whole, -most, most)).otherwise(whole))
