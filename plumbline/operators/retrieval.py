"""Chunks of documents, BM25 ranking, and recall of what is ranked."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx


#: Characters of a part of a long segment, and those that neighbouring parts share.
LONG, SHARED = 1026, 100
RANGES = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
SENTENCE_END = re.compile(r"(?<=[.!?…])[ \t]+(?=[«\"(]?[A-ZА-ЯЁ0-9])")
BLANK = re.compile(" ")


def packed(lengths: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open ranges of sentences with most characters at most; each starts `overlap` sentences before the last one's end."""
    out, start, n = [], 0, len(lengths)
    while start < n:
        end, total = start, 0
        while end < n and (end == start or total + lengths[end] <= most):
            total += lengths[end]
            end += 1
        out.append((start, end))
        if end >= n:
            break
        start = max(start + 1, end - overlap)
    return out


def chunks(documents: DataFrame, key: str, column: str, *, most_tokens: int = lex.CHUNK_TOKENS, overlap: int = lex.CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk, start, end, text): runs of whole sentences up to a number of estimated model tokens, one sentence apart.

    A sentence that is too long is a chunk of its own. Packing goes from chunk to chunk,
    so it runs on the arrays of sentence lengths; texts stay in the JVM."""
    rows = documents.select(F.col(key), F.col(column).alias("__text"), tx.sentence_array(F.col(column)).alias("__s"))
    most = int(most_tokens * lex.CHARS_PER_TOKEN)

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def ranges(lengths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lengths:
            yield batch.map(lambda x: [{"a": a, "b": b} for a, b in packed([int(v) for v in x], most, overlap)])

    sizes = F.transform("__s", lambda x: F.length(x))
    rows = rows.withColumn("__n", sizes).withColumn("__r", ranges(F.col("__n")))
    rows = rows.select(key, "__s", "__n", F.posexplode("__r").alias("chunk", "r"))
    before = F.aggregate(F.slice("__n", 1, F.col("r.a")), F.lit(0), lambda x, y: x + y)
    text = F.array_join(F.slice("__s", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")), "")
    return rows.select(key, "chunk", before.alias("start"), text.alias("text")).withColumn("end", F.col("start") + F.length("text")).select(key, "chunk", "start", "end", "text")


def bm25(queries: DataFrame, passages: DataFrame, key: str, k1: float = lex.BM25_K1, b: float = lex.BM25_B) -> DataFrame:
    """(key, passage, score): scores of the passages (key, passage, text) of each query (key, query) of the same key.

    Statistics are those of the key's own passages. Terms of a query count once."""
    terms = passages.select(key, "passage", F.explode(tx.search_terms(F.col("text"))).alias("term")).groupBy(key, "passage", "term").agg(F.count(F.lit(1)).alias("tf"))
    sizes = passages.select(key, "passage", F.size(tx.search_terms(F.col("text"))).alias("len"))
    whole = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    asked = queries.select(key, F.explode(F.array_distinct(tx.search_terms(F.col("query")))).alias("term"))
    df = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("df"))
    met = asked.join(terms, [key, "term"]).join(df, [key, "term"]).join(sizes, [key, "passage"]).join(whole, key)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return met.groupBy(key, "passage").agg(F.sum(part).alias("score"))


def top_passages(scores: DataFrame, key: str, k: int = 3, digits: int = 9) -> DataFrame:
    """The k best of each key; equal scores in order of the passage."""
    w = W.partitionBy(key).orderBy(F.round("score", digits).desc(), "passage")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(top: DataFrame, gold: DataFrame, key: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(k, n, recall): share of the keys of gold (key, passage) with a gold passage among the first k."""
    first = gold.join(top, [key, "passage"], "left").groupBy(key).agg(F.min("rank").alias("rank"))
    each = first.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)).alias("recall"))


def line_paragraphs(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(key, idx, text, start, end): what stands between line ends (blank lines as one); blank paragraphs are left out."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r"(\n\s*\n|\n|[^\n]+)"), F.lit(1))
    found = tx.placed(documents.select(key, column), [key], pieces, F.lit(0))
    return found.where(F.btrim("text", F.lit(tx.BLANKS)) != "")


def cut_at(size: int, ends: list[int], blanks: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open parts of a long text: of at most `most` characters, to the last sentence end (or else the last blank of the second half) in it, each `overlap` characters into the one before."""
    if size <= most:
        return [(0, size)]
    out, at = [], 0
    while at < size:
        end = min(at + most, size)
        if end < size:
            inside = bisect_right(ends, end - 1)
            if inside and ends[inside - 1] > at:
                end = ends[inside - 1]
            else:
                last = bisect_right(blanks, end - 1)
                if last and blanks[last - 1] > max(at, at + most // 2 - 1):
                    end = blanks[last - 1]
        out.append((at, end))
        if end >= size:
            break
        at = max(end - overlap, at + 1)
    return out


@F.pandas_udf(RANGES)
def _parts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: [{"a": a, "b": b} for a, b in cut_at(len(t), [m.end() for m in SENTENCE_END.finditer(t)], [m.start() for m in BLANK.finditer(t)], LONG, SHARED)])


def long_parts(segments: DataFrame, key: str, column: str) -> DataFrame:
    """(key, part, start, end): segments of more than LONG characters in parts that share SHARED; where one is cut depends on the cut before, so it runs text by text."""
    rows = segments.select(key, F.posexplode(_parts(F.coalesce(F.col(column), F.lit("")))).alias("part", "r"))
    return rows.select(key, "part", F.col("r.a").alias("start"), F.col("r.b").alias("end"))


def claim_passages(claims: DataFrame, passages: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, passage): the passages that are among the first k for any of the claims (key, claim, query) of a key, once each."""
    asked = claims.select(F.struct(key, "claim").alias("q"), key, F.col("query"))
    spread = asked.join(passages, key).select("q", "passage", "text")
    scores = bm25(asked.select("q", "query"), spread, "q")
    top = top_passages(scores, "q", k)
    return top.select(F.col(f"q.{key}").alias(key), "passage").distinct()
