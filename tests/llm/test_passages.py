import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.common import WordHashes, words_of
from plumbline.llm.passages import anchors, chains, common, extended, pieces, repeated_passages, sampled, trimmed


def brute_chain(found, gap):
    """Best score over all chains, by trying every predecessor."""
    order = sorted(found)
    best = {}
    for a in order:
        x, y, n = a
        score = float(n)
        for b in order:
            if b in best and b[0] + b[2] - 3 <= x and b[1] + b[2] - 3 <= y and b != a:
                score = max(score, best[b] + n - gap * (x - (b[0] + b[2] - 3) + y - (b[1] + b[2] - 3)))
        best[a] = score
    return max(best.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 80), st.integers(8, 14)), min_size=1, max_size=9, unique=True))
def test_fenwick_chains_are_best(found):
    found = sorted(found)
    got = chains(found, 0.5)
    assert sorted(a for c in got for a in c) == found

    def value(c):
        total = c[0][2]
        for (px, py, pn), (x, y, n) in zip(c, c[1:], strict=False):
            total += n - 0.5 * (x - px - pn + 3 + y - py - pn + 3)
        return total

    assert abs(max(value(c) for c in got) - brute_chain(found, 0.5)) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_is_the_longest_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert common(a, b) == table[-1, -1]


def test_parts():
    assert extended([1, 2, 3, 9, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 7, 8]) == (8, 7, 7)
    assert trimmed([(0, 0, 10), (9, 8, 10)]) == [(0, 0, 10), (11, 10, 8)]
    assert anchors(np.array([0, 4, 30]), np.array([10, 14, 40]), 8) == [(0, 10, 12), (30, 40, 8)]
    hashed = np.random.default_rng(0).integers(0, 1 << 62, 200).astype(np.uint64)
    at, _ = sampled(hashed, 5, 16)
    assert max(np.diff(at)) <= 16 and at[0] <= 15 and at[-1] >= 180 and len(at) < 80
    assert list(sampled(np.full(60, 7, np.uint64), 5, 16)[0])[:3] == [0, 1, 2]


def corpus(seed=2):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = [text(n) for n in (60, 75, 120, 45)]
    docs = {}
    for i in range(36):
        words = text(rng.choice([30, 120, 300]))
        if i % 2:
            part = list(shared[i % 4])
            if i % 8 == 5:
                part[len(part) // 2] = "edited"
                del part[len(part) // 2 + 12]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs[i] = " ".join(words)
    return docs


def test_finds_what_brute_force_finds(spark):
    docs = corpus()
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, home string, start_word long").repartition(4)
    got = repeated_passages(rows).collect()
    want = set()
    for a, b in combinations(sorted(docs), 2):
        x, y = docs[a].split(), docs[b].split()
        blocks = [m for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size >= 8]
        if blocks and blocks[-1].a + blocks[-1].size - blocks[0].a >= 50:
            want |= {a, b}
    assert {r["doc_id"] for r in got} | {r["other_doc"] for r in got} == want
    for r in got:
        x = docs[r["doc_id"]].split()[r["start_word"] : r["start_word"] + r["n_words"]]
        y = docs[r["other_doc"]].split()[r["other_start"] : r["other_start"] + r["other_words"]]
        assert r["other_doc"] < r["doc_id"] and len(x) == r["n_words"] >= 50
        assert abs(common(x, y) / max(len(x), len(y)) - r["identity"]) < 0.03 and r["identity"] >= 0.8


def test_copies_long_texts_and_odd_rows(spark):
    base = " ".join(f"a{i}" for i in range(70))
    long = " ".join(f"b{i}" for i in range(20_000))
    rows = [(1, base), (2, base), (3, base), (3, base), (4, long + " " + base), (5, None), (6, ""), (7, "short"), (None, base), (8, "same " * 400), (9, " ".join(["x"] * 49))]
    got = {(r["doc_id"], r["other_doc"], r["start_word"], r["n_words"]) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 1, 0, 70), (3, 1, 0, 70), (4, 1, 20_000, 70)}
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passage_pieced_together_from_two_documents(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    a, b = text(35), text(35)
    rows = [(1, text(60) + a), (2, b + text(60)), (3, text(40) + a + b + text(40))]
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["other_doc"], r["n_words"]) for r in got) == [(3, 1, 35), (3, 2, 35)]


def changed(words, share, rng):
    return [f"c{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def seeds_of(words):
    hashes = WordHashes()
    return set(sampled(hashes.of(words_of(" ".join(words))), 5, 16)[1].tolist())


def test_passages_with_edits_spread_through_them(spark):
    """Every edited copy that shares a seed with its passage is found."""
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], set()
    for i in range(0, 160, 2):
        words = text(60)
        edited = changed(words, 0.1, rng)
        edited[0], edited[-1] = words[0], words[-1]
        docs += [text(70) + words + text(70), text(70) + edited + text(70)]
        if seeds_of(docs[i]) & seeds_of(docs[i + 1]) and common(words, edited) >= 51:
            want.add(i + 1)
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert len(want) > 50 and want - {r["doc_id"] for r in got} == set()
    for r in got:
        x, y = docs[r["doc_id"]][r["start_word"] :][: r["n_words"]], docs[r["other_doc"]][r["other_start"] :][: r["other_words"]]
        assert r["other_doc"] == r["doc_id"] - 1 and 16 <= r["n_words"] <= 64 and common(x, y) >= 0.8 * max(len(x), len(y))


def test_words_of_a_repetitive_text_count_once(spark):
    rows = [(0, " ".join(["than"] * 39 + [f"a{i}" for i in range(40)])), (1, " ".join([f"b{i}" for i in range(40)] + ["than"] * 90)), (2, " ".join(["so"] * 58 + [f"c{i}" for i in range(9)])), (3, " ".join([f"d{i}" for i in range(9)] + ["so"] * 300))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_doc"]) for r in got} == {(3, 2)} and len(got) < 8


def test_pieces_of_a_chain_with_a_bad_gap():
    p, q = [[], list(range(30)), []], [[], list(range(100, 130)), []]
    assert sorted(pieces([0, 60], [0, 60], [30, 30], p, q, 0.8, 50)) == [(0, 30, 0, 30, 1.0), (60, 30, 60, 30, 1.0)]


def test_exact_passage_after_edited_variants(spark):
    """Seeds whose homes are several edited variants still find a passage that a later document holds word for word."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, last = [], []
    for _ in range(20):
        words = text(60)
        docs += [text(60) + changed(words, 0.1, rng) + text(60) for _ in range(4)]
        docs += [text(60) + words + text(60) for _ in range(2)]
        last.append(len(docs) - 1)
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert set(last) <= {r["doc_id"] for r in got}


def test_recall_with_an_edit_every_few_words(spark):
    rng = random.Random(1)
    text = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    docs, every = [], (6, 8, 10, 12, 16, 20)
    for e in every:
        for _ in range(30):
            words = text(80)
            edited = [f"c{rng.randrange(10**9)}" if j % e == e - 1 else w for j, w in enumerate(words)]
            docs += [text(60) + words + text(50), text(40) + edited + text(70)]
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in got if r["n_words"] >= 50}
    for n, e in enumerate(every):
        assert len(found & set(range(60 * n + 1, 60 * n + 60, 2))) >= 27, e
    assert all(i % 2 for i in found)


def test_passage_whose_parts_stand_in_earlier_documents(spark):
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    docs, last = [], []
    for _ in range(10):
        words = text(60)
        docs += [text(50) + words[at : at + 24] + text(50) for at in (0, 9, 18, 27, 36)]
        docs += [text(30) + words + text(30) for _ in range(2)]
        last += [len(docs) - 2, len(docs) - 1]
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(last)
