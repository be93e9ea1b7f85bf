"""MinHash near-dedup with odd sketches.

Method: every document's shingle set gives `samples` MinHash values. They are cut
into bands of `rows` values for candidate buckets, and folded into an odd sketch, a
bitmap of the parity of the values that hash to each bit. The XOR of two sketches
is the sketch of the samples in which two documents differ, so its population count
estimates high similarities; pairs that it puts far below the threshold go, the
others are confirmed on full shingle sets.

Large groups: equal sets collapse to one representative first. A bucket gives each
member one edge to its smallest member, not all pairs. Members of one bucket that are
still in different components then meet in blocks, where pairs are compared but only
the links that join components are kept. So no link between components is lost, a
group of m copies costs m edges, and no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import U64, WordHashes, dropped, fresh, mixed, shingles, sized, small_batches, words_of, written
from plumbline.llm.graph import components

SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"


class Sketcher:
    """MinHash values of a shingle set, as band keys and an odd sketch."""

    def __init__(self, samples: int, rows: int, bits: int, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.mul = draw.integers(1, 1 << 32, samples, dtype=np.uint32) | np.uint32(1)
        self.add = draw.integers(0, 1 << 32, samples, dtype=np.uint32)
        self.samples, self.rows, self.bits = samples, rows, bits
        self.lane = mixed(np.arange(1, samples + 1, dtype=U64))

    def values(self, found: np.ndarray) -> np.ndarray:
        low = np.full(self.samples, 0xFFFFFFFF, np.uint32)
        short = (found >> U64(32)).astype(np.uint32)
        for i in range(0, len(short), 2048):
            np.minimum(low, ((short[i : i + 2048, None] ^ self.add) * self.mul).min(axis=0), out=low)
        return low

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        laned = mixed(self.values(found).astype(U64) + self.lane)
        by_band = laned.reshape(-1, self.rows)
        keys = by_band[:, 0].copy()
        for j in range(1, self.rows):
            keys = keys * U64(0x9E3779B97F4A7C15) + by_band[:, j]
        odd = np.bincount((laned >> U64(20)) % U64(self.bits), minlength=self.bits) & 1
        sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
        return mixed(keys).view(np.int64), sketch


def most_bits(samples: int, bits: int, similarity: float) -> int:
    """The XOR population count that two sketches of this similarity are expected to have."""
    apart = 2 * samples * (1 - similarity)
    return math.floor(bits / 2 * (1 - (1 - 2 / bits) ** apart))


def signatures(documents: DataFrame, shingle: int, samples: int, rows: int, bits: int) -> DataFrame:
    """One row of SIGNATURE per row of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketcher = WordHashes(), Sketcher(samples, rows, bits)
        names = ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"]
        empty = np.zeros(0, np.int64)
        for batch in batches:
            count, first, second, keys, sketches = [], [], [], [], []
            for text in batch.column(1):
                found = np.unique(shingles(hashes.of(words_of(text.as_py())), shingle))
                digest = np.frombuffer(xxhash.xxh128_digest(found.tobytes()), np.int64)
                count.append(len(found))
                first.append(digest[0])
                second.append(digest[1])
                a, b = sketcher.of(found) if len(found) else (empty, empty)
                keys.append(a)
                sketches.append(b)
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32), np.concatenate([empty, *x])) for x in (keys, sketches)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), *lists], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def apart(x: str, y: str, bits: int) -> Column:
    """Population count of the XOR of two sketch columns."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, bits // 64)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def confirmed(pairs: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    The ids of pairs are broadcast against the texts only if their counted size allows;
    else both joins shuffle. b may be shared by very many pairs: that join has one text
    per b on its other side, so its skewed partitions can be split."""
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    left = texts.join(sized(pairs, 24), F.col("id") == F.col("a")).select("a", "b", F.col("text").alias("text_a"))
    hubs = written(pairs.select(F.col("b").alias("hub")).distinct(), "hubs")
    right = texts.join(sized(hubs, 16), F.col("id") == F.col("hub")).select("hub", F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last, known = None, None
        for batch in batches:
            good = []
            for x, hub, text, other in zip(*(c for c in batch.columns), strict=True):
                if last is None or not (last[0] == hub and last[1] == other):
                    last = (hub, other)
                    known = np.unique(shingles(hashes.of(words_of(other.as_py())), shingle))
                own = np.unique(shingles(hashes.of(words_of(text.as_py())), shingle))
                both = len(np.intersect1d(own, known, assume_unique=True))
                if both and 100 * both >= percent * (len(own) + len(known) - both):
                    good.append((x.as_py(), hub.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    joined = left.join(right.hint("merge"), F.col("b") == F.col("hub")).select("a", "b", "text_a", "text_b")
    out = written(joined.mapInArrow(run, "a long, b long").distinct(), "links")
    dropped(hubs)
    return out


#: Members of a bucket that are compared as one block with another.
BLOCK = 200


class Groups:
    """Union-find over a few nodes."""

    def __init__(self, labels: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def linked_in_block(reps: list[int], labels: list[int], sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray, percent: int, limit: int) -> list[tuple[int, int]]:
    """Links that join different components between the rows of side 0 and of side 1 (2: of both).

    Pairs that a link found before has brought into one component are skipped; all
    others that sizes and sketches allow are compared in full."""
    groups, out = Groups(labels), []
    sizes = np.array([len(x) for x in sets])
    for i in np.flatnonzero(side != 1):
        near = np.bitwise_count(sketches ^ sketches[i]).sum(axis=1) <= limit
        near &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & (side != 0) & ((side != 2) | (np.arange(len(sizes)) > i))
        for j in np.flatnonzero(near):
            x, y = groups.top(i), groups.top(j)
            if x != y:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    groups.up[max(x, y)] = min(x, y)
                    out.append((max(reps[i], reps[j]), min(reps[i], reps[j])))
    return out


def met_in_blocks(rows: DataFrame, sketches: DataFrame, documents: DataFrame, shingle: int, percent: int, limit: int) -> DataFrame:
    """Links (a, b) between members of one bucket in different components; rows: (key, rep, label, main, n_main, members).

    The members in the bucket's largest component (main) and the others are cut into
    blocks of BLOCK members each. A block of others meets every block, one of the main
    component only those of others. So no task holds more than two blocks however large
    the bucket is, rows are sent as often as there are blocks of others, and only links
    leave the task, not the pairs that were compared."""
    others, mains = F.ceil((F.col("members") - F.col("n_main")) / BLOCK).cast("int"), F.ceil(F.col("n_main") / BLOCK).cast("int")
    cut = rows.withColumn("others", others).withColumn("mains", mains).withColumn("in_main", F.col("label") == F.col("main"))
    draw = F.xxhash64("rep")
    cut = cut.withColumn("own", F.when(F.col("in_main"), F.col("others") + F.pmod(draw, F.col("mains"))).otherwise(F.pmod(draw, F.col("others"))).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(F.col("in_main"), 0).otherwise(F.col("mains")))))
    # Side 0 and 1 are the blocks of smaller and larger number, 2 is a block that meets itself.
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cut = cut.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "rep", "label")
    reps = written(rows.select("rep").distinct(), "reps")
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    texts = texts.join(sized(reps, 16), F.col("id") == F.col("rep")).select("rep", "text").join(sketches, "rep")
    # One text for each row of a large table: the side with the texts has one row per rep, the other can be split.
    met = cut.join(texts, "rep").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, group = WordHashes(), None, []

        def found() -> pa.RecordBatch:
            pairs = linked_in_block([g[0] for g in group], [g[1] for g in group], [g[2] for g in group], np.array([g[3] for g in group], np.int64).view(np.uint64), np.array([g[4] for g in group]), percent, limit) if group else []
            return pa.RecordBatch.from_arrays([pa.array([q[i] for q in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                now = tuple(cols[n][i].as_py() for n in ("key", "x", "y"))
                if now != at:
                    yield found()
                    at, group = now, []
                sets = np.unique(shingles(hashes.of(words_of(cols["text"][i].as_py())), shingle))
                group.append((cols["rep"][i].as_py(), cols["label"][i].as_py(), sets, cols["sketch"][i].as_py(), cols["side"][i].as_py()))
        yield found()

    out = written(met.mapInArrow(run, "a long, b long").distinct(), "links")
    dropped(reps)
    return out


def near_duplicates(documents: DataFrame, *, shingle: int = 5, percent: int = 80, samples: int = 128, rows: int = 4, bits: int = 512, slack: float = 0.2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of documents (doc_id, text).

    Documents whose sets of distinct lower-cased (A-Z) `shingle`-word shingles have
    100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id of the connected component. With 32 bands of 4 rows a pair at similarity
    0.8 meets in some bucket with probability 1 - 5e-8; `slack` (over 5 standard
    deviations at 128 samples) is what the sketch may err before exact confirmation.

    Null, empty or blank texts: no shingles, linked with nothing. Fewer words than
    `shingle`: the whole sequence is the one shingle. A null doc_id: the row is
    returned with a null component_id and kept, and links nothing. Repeated rows:
    every row is returned; rows that share an id are one node of the graph, so they
    link what their texts are linked with. Ties need
    no rule, the smallest id wins. Other columns of documents are not read."""
    small_batches(documents.sparkSession)
    signed = written(signatures(documents, shingle, samples, rows, bits), "signatures")
    live = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(live.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    limit = most_bits(samples, bits, percent / 100 - slack)

    buckets = classes.select("rep", F.explode("bands").alias("key"))
    # Written first, so that the join is between two shuffles and a hot bucket's rows can be split.
    hubs = written(buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top").select("key", "hub"), "bucket-hubs")
    active = written(buckets.join(hubs, "key"), "buckets")
    sketches = classes.select("rep", "sketch")

    def sketched(pairs: DataFrame) -> DataFrame:
        x = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
        y = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", apart("sketch_a", "sketch_b", bits).alias("apart")).where(F.col("apart") <= limit)

    near = written(sketched(active.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()), "near")
    best = written(near.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "best")
    # Rows that share an id are one node: the classes of their texts are linked through it.
    shared = live.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("s1").alias("x"), F.max("s1").alias("y")).where("n > 1 and x <> y").select("doc_id")
    shared = live.join(sized(written(shared, "shared-ids"), 16), "doc_id").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "rep")
    least = shared.groupBy("doc_id").agg(F.min("rep").alias("least"))
    joints = written(shared.join(least, "doc_id").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct(), "joints")
    links = confirmed(best, documents, shingle, percent).unionAll(joints)
    labels = components(links)

    def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components as far as known."""
        x = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        y = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    more = written(across(near.select("a", "b").join(best, ["a", "b"], "left_anti"), labels), "more")
    if not more.isEmpty():
        links = links.unionAll(confirmed(more, documents, shingle, percent))
        labels = components(links)

    # What is left: buckets whose members are in different components.
    named = active.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    each = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    each = written(each.select("key", F.col("main.label").alias("main"), F.col("main.n").alias("n_main"), "members"), "mixed-buckets")
    open_ = written(named.join(each, "key"), "open")
    if not open_.isEmpty():
        links = links.unionAll(met_in_blocks(open_, sketches, documents, shingle, percent, limit))
        labels = components(links)
    for used in (near, best, more, each, open_, active, hubs):
        dropped(used)

    least = classes.select("s1", "s2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("label", "rep").alias("label"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(least, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """documents without those that have a near duplicate of smaller id in their component; all columns stay."""
    gone = fresh(documents)("gone")
    found = written(near_duplicates(documents, **options).where("not kept").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    return documents.join(sized(found, 16), documents["doc_id"].cast("long") == F.col(gone), "left_anti")
