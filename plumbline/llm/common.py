"""What the operators share: scratch tables, size-checked broadcasts, words and shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.scratch import dropped, finished, shared_folder, written

__all__ = ["dropped", "finished", "shared_folder", "written"]

#: A side is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 48 << 20

#: Words are runs of anything but these six ASCII characters (regex form).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)


def sized(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """df with a broadcast hint if its rows fit BROADCAST_BYTES, else df itself (a shuffle join).

    row_bytes is the width of a row, an expression where rows hold arrays or texts. df
    should be cheap to read, as a written table is."""
    width = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    taken = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if taken <= BROADCAST_BYTES else df


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for what runs within; the caller's settings come back."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n, None) for n in names]
    for n, value in zip(names, (rows, size), strict=True):
        spark.conf.set(n, str(value))
    try:
        yield
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, so that batches of long texts fit a Python worker.

    Results are read lazily, so the setting stays; it is the engine's own for all its plans."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fresh(*tables: DataFrame | list[str]) -> Callable[[str], str]:
    """Names that no column of the tables has, whatever the case of their letters."""
    taken = {c.lower() for t in tables for c in (t if isinstance(t, list) else t.columns)}

    def name(wish: str) -> str:
        while wish.lower() in taken:
            wish += "_"
        taken.add(wish.lower())
        return wish

    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, as long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


class WordHashes(dict):
    """64-bit hash of each word (bytes); emptied when it holds too many."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit values, so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; with fewer words, of the whole sequence; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    m = min(n, k)
    acc = hashes[: n - m + 1].copy()
    for j in range(1, m):
        acc = acc * _P + hashes[j : n - m + 1 + j]
    return mixed(acc + U64(m))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() splits at exactly the six ASCII spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
