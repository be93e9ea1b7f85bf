"""Benchmark decontamination by shared shingles of item-sized windows.

A document is compared with the items of whose weighted word shingles it holds enough
for the wanted similarity, and there the windows as long as the item that hold enough
of them. Both bounds are exact, so no window is lost. What is left is confirmed by
the exact weighted similarity of the two shingle multisets; the distance of their
64-bit SimHashes is reported with it.

Items go to the executors in blocks of `item_block`, one pass of the documents for
each. A task holds one block and, for all of them, 16 bytes a shingle that several
items share, so that blocks don't change the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import U64, WORD, WordHashes, fresh, shingles, sized, small_batches, words_of, written

#: What the order of a sum of doubles may change: similarities nearer to the threshold than this reach it.
TIE = 1e-9
LEAKS = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"
BITS = 64


def planes(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each shingle its weight, signed by each of the 64 bits of its hash."""
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1)
    return (bits.astype(np.float64) * 2 - 1) * weights[:, None]


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 1e-3, axis=1).view(U64).ravel()


#: Bits of a shingle's hash that the quick test of a block looks at.
QUICK = 20


class Items:
    """A block of benchmark items: their shingles with weights, and the items of each shingle.

    An item of fewer words than a shingle has its whole sequence as its one shingle."""

    def __init__(self, rows: list[tuple[int, str]], weight: Weights, shingle: int) -> None:
        hashes = WordHashes()
        self.weights = weight.of
        self.items: list[tuple[int, int, np.ndarray]] = []
        for item, text in rows:
            words = words_of(text)
            if words:
                self.items.append((item, len(words), shingles(hashes.of(words), shingle)))
        #: Words of a shingle -> whether any item has that; a document is cut into each of these.
        self.sizes = sorted({min(length, shingle) for _, length, _ in self.items})
        own = [np.unique(f, return_counts=True) for _, _, f in self.items]
        self.whole = np.array([float(self.weights(f).sum()) for _, _, f in self.items])
        keys = np.concatenate([u for u, _ in own]) if own else np.array([], U64)
        self.vocabulary, place = np.unique(keys, return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.holder = np.repeat(np.arange(len(own)), [len(u) for u, _ in own])[order]
        self.times = (np.concatenate([n for _, n in own]) if own else np.array([], int))[order]
        self.first = np.searchsorted(place[order], np.arange(len(self.vocabulary) + 1))
        self.quick = np.zeros(1 << QUICK, bool)
        self.quick[self.vocabulary >> U64(64 - QUICK)] = True

    def similarity(self, item: np.ndarray, window: np.ndarray) -> float:
        """Sum of the smaller over sum of the larger weighted counts of all shingles."""
        keys, place = np.unique(np.concatenate([item, window]), return_inverse=True)
        a = np.bincount(place[: len(item)], minlength=len(keys))
        b = np.bincount(place[len(item) :], minlength=len(keys))
        w = self.weights(keys)
        return float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum())

    def candidates(self, found: np.ndarray, least: float) -> np.ndarray:
        """Numbers of the items of which a document holds enough weight for a window to reach least."""
        found = found[self.quick[found >> U64(64 - QUICK)]]
        if not len(found):
            return found
        place = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        place = place[self.vocabulary[place] == found]
        if not len(place):
            return place
        met, counts = np.unique(place, return_counts=True)
        sizes = self.first[met + 1] - self.first[met]
        at = np.repeat(self.first[met] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        both = np.minimum(self.times[at], np.repeat(counts, sizes)) * np.repeat(self.weights(self.vocabulary[met]), sizes)
        held = np.bincount(self.holder[at], both, len(self.items))
        return np.flatnonzero((held > 0) & (held >= least * self.whole - 1e-6))

    def leaks(self, hashed: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
        """(item, start, words, distance, similarity): for every item its best window in a document, if it reaches least."""
        out: dict[int, tuple] = {}
        for size in self.sizes:
            if len(hashed) >= size:
                self.met(shingles(hashed, size), size, len(hashed), least, out)
        return [(item, start, length, distance, -likeness) for item, (likeness, start, length, distance) in out.items()]

    def met(self, found: np.ndarray, size: int, n_words: int, least: float, out: dict[int, tuple]) -> None:
        """Put into out the best window for each item whose shingles have `size` words."""
        for i in self.candidates(found, least).tolist():
            item, length, own = self.items[i]
            if min(length, size) != size or (length < size):
                continue
            # A document shorter than the item is one window itself.
            n = min(len(own), len(found))
            # A window can't share more than the weight of those of its shingles that the item has.
            weighed = self.weights(found)
            shared = np.where(np.isin(found, own), weighed, 0.0)
            sums = np.concatenate([[0.0], np.cumsum(shared)])
            all_ = np.concatenate([[0.0], np.cumsum(weighed)])
            held = sums[n:] - sums[:-n]
            # Nor can it be more like the item than that over all weight of both that isn't shared.
            bound = held / np.maximum(self.whole[i] + all_[n:] - all_[:-n] - held, 1e-12)
            starts = np.flatnonzero(bound >= least - 1e-6)
            best = None
            for s in starts[np.argsort(-bound[starts], kind="stable")].tolist():
                if best is not None and bound[s] < -best[0] - 1e-6:
                    break
                likeness = self.similarity(own, found[s : s + n])
                if likeness >= least - TIE:
                    best = min(best or (0.0, 0), (-round(likeness, 12), s))
            if best is not None:
                likeness, s = best
                prints = [packed(planes(f, self.weights(f)).sum(axis=0, keepdims=True))[0] for f in (own, found[s : s + n])]
                row = (likeness, s, min(length, n_words), int(np.bitwise_count(prints[0] ^ prints[1])))
                out[item] = min(out.get(item, row), row)


def leaks(documents: DataFrame, benchmark: DataFrame, *, shingle: int = 5, similarity: float = 0.8, item_block: int = 20_000) -> DataFrame:
    """LEAKS: for each document and benchmark item found in it, the best window.

    documents (doc_id, text) and benchmark (item_id, text); words are lower-cased (A-Z).
    The similarity is that of the multisets of `shingle`-word shingles, weighted by
    1 + ln(items / items that hold the shingle). All windows that reach it are found;
    hamming is the distance of the two 64-bit SimHashes.

    A document shorter than an item is compared with it as a whole. An item of fewer than
    `shingle` words has its whole sequence as its one shingle, so it is found where it
    stands word for word. Null, empty and blank documents and items match nothing. Rows
    with a null id are reported with it. A similarity at the threshold reaches it,
    whatever the order of the sums. Equal windows: the first. Repeated documents give a row each, a
    repeated item_id one row for its best text. Empty tables give no rows; other
    columns are not read."""
    spark = documents.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("text").rlike(WORD))
    items = written(items.withColumn("n", F.monotonically_increasing_id()), "items")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for text in batch.column(0):
                found = np.unique(shingles(hashes.of(words_of(text.as_py())), shingle)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["h"])

    held = items.select("text").mapInArrow(of_items, "h long").groupBy("h").count()
    total = items.count()
    weights = written(held.select("h", (1 + F.log(F.lit(float(max(total, 1))) / F.col("count"))).alias("weight")).where(F.col("count") > 1), "weights")
    alone = 1 + float(np.log(max(total, 1)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # Every block needs the weights of all shared shingles: a window may hold shingles of items of other blocks.
    shared = weights.select("h", "weight").toArrow()
    common = spark.sparkContext.broadcast((shared.column("h").to_numpy().view(U64), shared.column("weight").to_numpy()))

    blocks = max(1, -(-total // item_block))
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == k)
        block = [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Items(sent.value, Weights(alone, *common.value), shingle)
            hashes = WordHashes()
            for batch in batches:
                rows = [(d.as_py(), *leak) for d, t in zip(*batch.columns, strict=True) for leak in index.leaks(hashes.of(words_of(t.as_py())), similarity)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

        found = rows.mapInArrow(run, LEAKS)
        out = found if out is None else out.unionAll(found)
    return out


class Weights:
    """Shingle weights; a shingle of one item, or of none, has the largest."""

    def __init__(self, alone: float, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.alone, self.keys, self.values = alone, keys[order], values[order]

    def of(self, found: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(found), self.alone)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return np.where(self.keys[at] == found, self.values[at], self.alone)


def without_leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """documents that hold no benchmark item, with all their columns."""
    gone = fresh(documents)("gone")
    found = written(leaks(documents, benchmark, **options).select(F.col("doc_id").alias(gone)).distinct(), "leaks")
    return documents.join(sized(found, 16), documents["doc_id"].cast("long") == F.col(gone), "left_anti")
