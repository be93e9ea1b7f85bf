"""Substring dedup by collinear chaining.

Seeds are word k-mers whose hash is in the lowest quarter, and of every `window`
k-mers without such a one that of smallest hash. So whether a k-mer is a seed hardly
depends on the words around it, edited passages keep their seeds, and texts that share
k + window - 1 words share one for certain. A seed is joined to the document of smallest
id that leads its like (its home): of the places of a seed in order, one whose words
before and after, as a sketch, agree with those of no leader leads, and all are compared
with all leaders. So a seed that also stands elsewhere, among other words, loses no link.
Per document and home, seeds that continue each other become anchors, and anchors in
order in both texts are chained, with a cost for the words between them, by a Fenwick
tree of prefix maxima. Chains are then aligned: the words between anchors and beyond
the ends are fetched from both texts, which gives the passage's ends and its identity.
Length and identity are tested on what is aligned, so one shared seed is enough.

Equal texts are collapsed first. Whatever number of documents share a passage, each
has one row of seeds per seed, so the work grows with the words of the corpus.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import U64, WordHashes, batches_of, dropped, shingles, sized, small_batches, word_count, words_of, written
from plumbline.scratch import shuffles_deleted

#: All chains of a document and a home: their anchors one after the other, and how many each chain has.
CHAINS = "doc_id long, home long, xs array<int>, ys array<int>, lens array<int>, sizes array<int>"

#: Two anchors of a chain may overlap by so many words; the later one is then cut.
OVERLAP = 3


#: Words on each side of a seed that its sketch holds, one of 32 bits for each.
AROUND = 12


def sampled(hashed: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the seeds of a text; none if it has fewer than k words."""
    if len(hashed) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = shingles(hashed, k)
    at = np.flatnonzero(found < U64(1 << 62))
    edge = np.concatenate([[-1], at, [len(found)]])
    bare = np.flatnonzero(np.diff(edge) > window)
    if len(bare):
        more = []
        for a, b in zip((edge[bare] + 1).tolist(), edge[bare + 1].tolist(), strict=True):
            views = np.lib.stride_tricks.sliding_window_view(found[a:b], window)
            more.append(a + views.argmin(axis=1) + np.arange(len(views)))
        at = np.unique(np.concatenate([at, *more]))
    return at, found[at]


def around(hashed: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Sketches of the AROUND words before (high half) and after each seed; 0 where the text has fewer."""
    n, starts = len(hashed), len(hashed) - AROUND + 1
    if starts < 1:
        return np.zeros(len(at), np.int64)
    one = np.left_shift(np.uint32(1), (hashed >> U64(59)).astype(np.uint32))
    two = one[:-1] | one[1:]
    four = two[:-2] | two[2:]
    wide = four[: starts] | four[4 : 4 + starts] | four[8 : 8 + starts]
    before = np.where(at >= AROUND, wide[np.maximum(at - AROUND, 0)], 0).astype(U64)
    after = np.where(at + k + AROUND <= n, wide[np.minimum(at + k, starts - 1)], 0).astype(U64)
    return (before << U64(32) | after).view(np.int64)


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two sketches share most bits of one half."""
    out = np.zeros(len(a), bool)
    for shift in (0, 32):
        x, y = ((v.view(U64) >> U64(shift)).astype(np.uint32) for v in (a, b))
        most = np.maximum(np.bitwise_count(x), np.bitwise_count(y)).astype(np.int32)
        out |= (x != 0) & (y != 0) & (20 * np.bitwise_count(x & y).astype(np.int32) >= 13 * most)
    return out


def led(h: np.ndarray, doc: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, their homes, leaders) as places in rows ordered by seed, document and place.

    A row whose surroundings agree with those of no leader of its seed leads; any other has
    the first such leader as its home, and has none if that is in its own document."""
    left = np.arange(len(h))
    rows, homes, leaders = [], [], []
    while len(left):
        new = np.ones(len(left), bool)
        new[1:] = h[left[1:]] != h[left[:-1]]
        lead = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        met = ~new & agree(near[left], near[lead])
        other = met & (doc[left] != doc[lead])
        rows.append(left[other])
        homes.append(lead[other])
        leaders.append(left[new])
        left = left[~met & ~new]
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, homes, leaders))


def anchors(x: np.ndarray, y: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(x, y, words) of runs of seeds on one diagonal that touch or overlap, ordered by x."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(x - y) != 0) | (np.diff(x) > k)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    return sorted(zip(x[first].tolist(), y[first].tolist(), (x[last] - x[first] + k).tolist(), strict=True))


class Fenwick:
    """Largest (score, index) over prefixes."""

    def __init__(self, size: int) -> None:
        self.best = [(-1e18, -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if self.best[at] < value:
                self.best[at] = value
            at += at & -at

    def until(self, at: int) -> tuple[float, int]:
        """Over positions below at."""
        out = (-1e18, -1)
        while at:
            if self.best[at] > out:
                out = self.best[at]
            at -= at & -at
        return out


def chains(found: list[tuple[int, int, int]], gap: float) -> list[list[tuple[int, int, int]]]:
    """Anchors in chains of best score (words less gap * words between, in both texts); every anchor is in one chain at most."""
    if len(found) == 1:
        return [found]
    cuts = sorted({y + n - OVERLAP for _, y, n in found})
    rank = {v: i for i, v in enumerate(cuts)}
    tree = Fenwick(len(cuts))
    # An anchor can follow those that end (but for OVERLAP words) where it starts, in both texts.
    events = sorted([(x, 1, i) for i, (x, _, _) in enumerate(found)] + [(x + n - OVERLAP, 0, i) for i, (x, _, n) in enumerate(found)])
    score, back = [0.0] * len(found), [-1] * len(found)
    ends = np.array(cuts)
    for _, start, i in events:
        x, y, n = found[i]
        if start:
            best, j = tree.until(int(np.searchsorted(ends, y, side="right")))
            best -= gap * (x + y)
            score[i], back[i] = (n + best, j) if j >= 0 and best > 0 else (float(n), -1)
        else:
            tree.put(rank[y + n - OVERLAP], (score[i] + gap * (x + y + 2 * n - 2 * OVERLAP), i))
    out, used = [], [False] * len(found)
    for i in sorted(range(len(found)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(found[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def trimmed(chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The chain with overlaps cut from the start of the later anchor."""
    out = [chain[0]]
    for x, y, n in chain[1:]:
        px, py, pn = out[-1]
        cut = max(0, px + pn - x, py + pn - y)
        if n > cut:
            out.append((x + cut, y + cut, n - cut))
    return out


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a machine word of b at a time."""
    if not a or not b:
        return 0
    places: dict = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        met = row & places.get(w, 0)
        row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


def extended(a: list, b: list, cost: int = 2) -> tuple[int, int, int]:
    """(words of a, words of b, matches) by which a match before a and b goes on.

    Of all m, the first m words of both where matches - cost * (m - matches) is largest,
    less what follows the last match."""
    places: dict = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    rows = [row]
    best, most, until = 0, 0, 0
    for m in range(1, max(len(a), len(b)) + 1):
        if m <= len(a):
            met = row & places.get(a[m - 1], 0)
            row = ((row + met) | (row - met)) & full
            rows.append(row)
        n = min(m, len(b))
        matches = n - (row & (1 << n) - 1).bit_count()
        if (1 + cost) * matches - cost * m > best:
            best, most, until = (1 + cost) * matches - cost * m, matches, m
    n = min(until, len(b))
    i = next(i for i, r in enumerate(rows) if n - (r & (1 << n) - 1).bit_count() == most)
    j = next(j for j in range(n + 1) if j - (rows[i] & (1 << j) - 1).bit_count() == most)
    return i, j, most


def pieces(xs: list[int], ys: list[int], lens: list[int], p: list[list], q: list[list], identity: float, least_words: int) -> Iterator[tuple[int, int, int, int, float]]:
    """(start, words, other start, other words, identity) of a chain with its gaps and ends (p, q) aligned.

    Where a chain as a whole has less than the identity, its parts are tried, cut at the worst gap."""
    inner = [0, *(common(u, v) for u, v in zip(p[1:-1], q[1:-1], strict=True))]
    todo = [(0, len(xs))]
    while todo:
        i, j = todo.pop()
        core = sum(lens[i:j]) + sum(inner[i + 1 : j])
        found = None
        # Ends of less than the identity are tried first, as better words between may make up for them; a short passage may take worse ones.
        for cost in (2, 4, 1):
            if found is not None and (cost == 4 or found[1] >= least_words):
                continue
            a, b, left = extended(p[i][::-1], q[i][::-1], cost)
            c, d, right = extended(p[j], q[j], cost)
            x, y = xs[i] - a, ys[i] - b
            nx, ny = xs[j - 1] + lens[j - 1] + c - x, ys[j - 1] + lens[j - 1] + d - y
            alike = (core + left + right) / max(nx, ny)
            if alike >= identity and (cost > 1 or nx >= least_words):
                found = (x, nx, y, ny, alike)
        if found is not None:
            yield found
        elif j - i > 1:
            worst = max(range(i + 1, j), key=lambda g: identity * max(len(p[g]), len(q[g])) - inner[g])
            todo += [(i, worst), (worst, j)]


def gaps(starts: list[int], lens: list[int], margin: int) -> list[tuple[int, int]]:
    """The intervals of a text that an alignment looks at: before, between and after the anchors."""
    out = [(max(0, starts[0] - margin), starts[0])]
    out += [(s + n, t) for s, n, t in zip(starts, lens, starts[1:], strict=False)]
    return [*out, (starts[-1] + lens[-1], starts[-1] + lens[-1] + margin)]


def stretches(starts: list[int], lens: list[int], sizes: list[int], margin: int) -> list[tuple[int, int]]:
    """The intervals that the alignments of several chains look at, those that meet as one."""
    out: list[tuple[int, int]] = []
    at, asked = 0, []
    for n in sizes:
        asked.append((max(0, starts[at] - margin), starts[at + n - 1] + lens[at + n - 1] + margin))
        at += n
    for a, b in sorted(asked):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Cut:
    """Words of a text of which only some stretches are at hand."""

    def __init__(self, starts: list[int], words: list[list[int]]) -> None:
        self.starts, self.words = starts, words

    def between(self, a: int, b: int) -> list[int]:
        i = bisect_right(self.starts, a) - 1
        return self.words[i][a - self.starts[i] : b - self.starts[i]]


def passages_of(xs: list[int], ys: list[int], lens: list[int], sizes: list[int], doc: Cut, home: Cut, identity: float, least_words: int, least_piece: int) -> list[tuple[int, int, int, int, float]]:
    """The aligned pieces of all chains of a document and a home, the longest chains first.

    A chain whose words are in a piece found before has nothing to add, as in texts that
    repeat themselves, where each repeat meets the same words of the home."""
    edge = [0]
    for n in sizes:
        edge.append(edge[-1] + n)
    order = sorted(range(len(sizes)), key=lambda c: (-sum(lens[edge[c] : edge[c + 1]]), xs[edge[c]], ys[edge[c]]))
    out: list[tuple[int, int, int, int, float]] = []
    firsts: list[int] = []
    reach: dict[int, int] = {}
    for c in order:
        i, j = edge[c], edge[c + 1]
        at = bisect_right(firsts, xs[i]) - 1
        if at >= 0 and reach[firsts[at]] >= xs[j - 1] + lens[j - 1]:
            continue
        p = [doc.between(a, b) for a, b in gaps(xs[i:j], lens[i:j], least_words)]
        q = [home.between(a, b) for a, b in gaps(ys[i:j], lens[i:j], least_words)]
        for piece in pieces(xs[i:j], ys[i:j], lens[i:j], p, q, identity, least_words):
            x, n = piece[:2]
            if n >= least_piece:
                out.append(piece)
                # Of found pieces, those in another are forgotten, so that ends are ordered as starts are.
                at = bisect_right(firsts, x)
                if at and reach[firsts[at - 1]] >= x + n:
                    continue
                if at and firsts[at - 1] == x:
                    at -= 1
                    del firsts[at]
                while at < len(firsts) and reach[firsts[at]] <= x + n:
                    del firsts[at]
                firsts.insert(at, x)
                reach[x] = x + n
    return out


PASSAGES = "doc_id long, start_word long, n_words long, other_doc long, other_start long, other_words long, identity double"


def repeated_passages(documents: DataFrame, *, k: int = 5, window: int = 16, least_words: int = 50, least_piece: int = 16, identity: float = 0.8, gap: float = 0.05) -> DataFrame:
    """PASSAGES: stretches of documents (doc_id, text) that occur, at least nearly, in a document of smaller id.

    Words are lower-cased (A-Z). A passage has least_words words, or is part of a run of
    pieces (of least_piece words or more, from several documents) that has, and at least
    `identity` of its words are matched in order. Exact copies of a whole text of
    least_words words or more get one row to the copy of smallest id. Texts with fewer
    words, null texts and rows of null id hold no passages; repeats within one document
    are none. Rows that share an id are one document. Ties: the earliest words, the
    smallest ids. An empty table gives no rows; other columns are not read."""
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.withColumn("md5", F.unhex(F.md5("text")))
    # Aggregates are written before they are joined, so that both sides are shuffles and the rows of a very common key can be split.
    ids = written(rows.select("doc_id", "md5", word_count(F.col("text")).alias("n")).where(F.col("n") >= least_words), "texts")
    first = written(ids.groupBy("md5").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("md5", "least"), "least-copies")
    copies = written(ids.join(sized(first, 48), "md5").where("doc_id <> least").select("doc_id", "md5", "least", "n").distinct(), "copies")
    dropped(ids)
    dropped(first)
    gone = sized(copies.select("doc_id", "md5"), 64)
    texts = rows.join(gone, ["doc_id", "md5"], "left_anti").select("doc_id", "text")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                doc, at, h, near = [], [], [], []
                part = batch.slice(start, 500)
                for i, t in zip(part.column(0), part.column(1), strict=True):
                    words = words_of(t.as_py())
                    if len(words) >= least_words:
                        hashed = hashes.of(words)
                        x, y = sampled(hashed, k, window)
                        doc.append(np.full(len(x), i.as_py(), np.int64))
                        at.append(x.astype(np.int32))
                        h.append(y.view(np.int64))
                        near.append(around(hashed, x, k))
                if doc:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (h, doc, at, near)], ["h", "doc_id", "at", "near"])

    # Seeds are read once, so they are no table beside their shuffle; that goes when the chains stand.
    seeded = texts.mapInArrow(seeds, "h long, doc_id long, at int, near long")

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by seed, document and place; the leaders of a batch's last seed go before the next batch."""
        known: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("h", "doc_id", "at", "near")]
            if not len(cols[0]):
                continue
            if known is not None:
                cols = [np.concatenate(z) for z in zip(known, cols, strict=True)]
            h, doc, at, near = cols
            row, home, leaders = led(h, doc, near)
            last = np.sort(leaders[h[leaders] == h[-1]])
            known = [c[last] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[row], doc[home], at[row], at[home])], ["doc_id", "home", "x", "y"])

    met = seeded.repartition("h").sortWithinPartitions("h", "doc_id", "at").mapInArrow(homed, "doc_id long, home long, x int, y int")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by document and home; the last pair of a batch waits for the next batch."""
        names = ["doc_id", "home", "x", "y"]
        wait: list[np.ndarray] | None = None

        def done(cols: list[np.ndarray]) -> pa.RecordBatch:
            doc, home, x, y = cols
            out: list[list] = [[], [], [], [], [], []]
            edge = np.flatnonzero((np.diff(doc) != 0) | (np.diff(home) != 0)) + 1
            for a, b in zip([0, *edge], [*edge, len(doc)], strict=True):
                if b > a:
                    found = list(map(trimmed, chains(anchors(x[a:b], y[a:b], k), gap)))
                    row = (int(doc[a]), int(home[a]), *([c[i] for chain in found for c in chain] for i in range(3)), [len(chain) for chain in found])
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "home", "xs", "ys", "lens", "sizes"])

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
            if wait is not None:
                cols = [np.concatenate(z) for z in zip(wait, cols, strict=True)]
            if not len(cols[0]):
                continue
            tail = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(tail[-1]) + 1 if len(tail) else 0
            wait = [c[cut:] for c in cols]
            if cut:
                yield done([c[:cut] for c in cols])
        if wait is not None:
            yield done(wait)

    spread = met.repartition("doc_id").sortWithinPartitions("doc_id", "home", "x", "y")
    with batches_of(spark, 50_000), shuffles_deleted(spark):
        linked = written(spread.mapInArrow(chained, CHAINS).withColumn("id", F.monotonically_increasing_id()), "chains")

    def words_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches of words that each asking pair's alignments look at."""
        hashes = WordHashes()
        numbers = pa.list_(pa.int32())
        for batch in batches:
            for text, asks in zip(batch.column(0), batch.column(1), strict=True):
                own = hashes.of(words_of(text.as_py())).astype(np.uint32).view(np.int32)
                asks = asks.as_py()
                at = [stretches(ask["starts"], ask["lens"], ask["sizes"], least_words) for ask in asks]
                ids = pa.array([ask["id"] for ask in asks], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([[a for a, _ in x] for x in at], numbers), pa.array([[own[a:b] for a, b in x] for x in at], pa.list_(numbers))], ["id", "starts", "words"])

    def parts(of: str, starts: str, name: str) -> DataFrame:
        # A text's pairs are asked for together; those of a common home in as many rows as tasks wrote them.
        asks = linked.groupBy(F.col(of).alias("asked"), F.shiftright("id", 33).alias("task")).agg(F.collect_list(F.struct("id", F.col(starts).alias("starts"), "lens", "sizes")).alias("asks"))
        asks = written(asks.drop("task"), "asks")
        scratch.append(asks)
        # Always a shuffle, the same for both sides: asks grow with the corpus, and a broadcast while they are few would only hide what texts take later.
        got = texts.join(asks.hint("merge"), F.col("doc_id") == F.col("asked")).select("text", "asks")
        return got.mapInArrow(words_between, "id long, starts array<int>, words array<array<int>>").select("id", F.col("starts").alias(f"{name}_at"), F.col("words").alias(name))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.float64()]
        for batch in batches:
            out = []
            for doc, home, xs, ys, lens, sizes, p_at, p, q_at, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x, nx, y, ny, alike in passages_of(xs, ys, lens, sizes, Cut(p_at, p), Cut(q_at, q), identity, least_words, least_piece):
                    out.append((doc, x, nx, home, y, ny, alike))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [x.split()[0] for x in PASSAGES.split(", ")])

    scratch: list[DataFrame] = []
    both = linked.join(parts("doc_id", "xs", "p"), "id").join(parts("home", "ys", "q"), "id").select("doc_id", "home", "xs", "ys", "lens", "sizes", "p_at", "p", "q_at", "q")
    with shuffles_deleted(spark):
        found = written(both.mapInArrow(aligned, PASSAGES).distinct(), "passages")
    for used in (linked, *scratch):
        dropped(used)
    # In a text that repeats itself, the same words of the other text meet many shifted stretches: those that overlap count once.
    end = F.col("start_word") + F.col("n_words")
    shifted = W.partitionBy("doc_id", "other_doc", "other_start").orderBy("start_word", F.desc("n_words"))
    found = found.withColumn("before", F.lag(end).over(shifted)).where("before is null or start_word >= before").drop("before")
    inside = W.partitionBy("doc_id", "other_doc").orderBy("start_word", F.desc("n_words"), "other_start").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("before", F.max(end).over(inside)).where(F.col("before").isNull() | (end > F.col("before"))).drop("before")
    # Runs of passages that touch (a seed's words apart at most); a run's rows stay if it is long enough.
    order = W.partitionBy("doc_id").orderBy("start_word", "other_doc", "other_start")
    reach = F.max(F.col("start_word") + F.col("n_words")).over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.col("start_word") <= reach + k, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = W.partitionBy("doc_id", "run")
    runs = runs.withColumn("words", F.max(F.col("start_word") + F.col("n_words")).over(whole) - F.min("start_word").over(whole))
    names = [x.split()[0] for x in PASSAGES.split(", ")]
    whole_copies = copies.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("n_words"), F.col("least").alias("other_doc"), F.lit(0).cast("long").alias("other_start"), F.col("n").alias("other_words"), F.lit(1.0).alias("identity"))
    return runs.where(F.col("words") >= least_words).select(*names).unionAll(whole_copies.select(*names))
