import random
from itertools import combinations

import numpy as np
import pytest

from plumbline.llm.graph import components
from plumbline.llm.near_dedup import Sketcher, most_bits, near_duplicates, without_near_duplicates

DOCS = "doc_id long, text string, source string, label string, key string, hub string"


def sets_of(texts, k):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(texts, k=5, percent=80):
    sets = sets_of(texts, k)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 40, 90, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[n] = rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy)
            n += 1
    texts |= {n: None, n + 1: "", n + 2: " \n\t", n + 3: "Alone", n + 4: "alone", n + 5: "a b", n + 6: "ÀB a"}
    order = list(texts)
    rng.shuffle(order)
    return {order[i]: t for i, t in enumerate(texts.values())}


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_brute_force(spark, k):
    texts = corpus(k)
    docs = spark.createDataFrame([(i, t, "s", "l", "k", "h") for i, t in texts.items()], DOCS).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, shingle=k).collect()}
    assert got == brute(texts, k)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text, None, "", "", ""), (4, text, "x", "", "", ""), (9, text + " end", "", "", "", ""), (None, text, "", "", "", "")], DOCS)
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [("4", "4", True), ("4", "4", True), ("9", "4", False), ("None", "None", True)]
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == 3
    assert near_duplicates(docs.limit(0)).collect() == []


def test_large_group_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[i % 120] = f"x{i}"
        rows.append((i, " ".join(copy), "", "", "", ""))
    got = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    sketcher = Sketcher(128, 4, 512)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for similarity in (0.5, 0.8, 0.95):
        far = []
        for _ in range(40):
            n = 400
            both = int(2 * n * similarity / (1 + similarity))
            draw = rng.permutation(pool)[: 2 * n - both]
            x, y = sketcher.of(draw[:n])[1], sketcher.of(draw[n - both :])[1]
            far.append(int(np.bitwise_count((x ^ y).view(np.uint64)).sum()))
        assert abs(np.mean(far) - most_bits(128, 512, similarity)) < 8


def test_buckets_of_unlinked_members_meet_in_blocks(spark, monkeypatch):
    """A family whose members are often too far from the smallest one, in blocks of three."""
    monkeypatch.setattr("plumbline.llm.near_dedup.BLOCK", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(120):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8])):
            copy[rng.randrange(150)] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == brute(texts)
    assert 1 < len({c for _, c, _ in got.values()}) < 120


def test_rows_that_share_an_id_link_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b), (11, "alone in the table"), (12, None), (12, b)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gone int")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (12, 3, False), (12, 12, True)}
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 11]


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:])), (3, " ".join(words[30_000:]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {1: (59_997, 1), 2: (58_997, 1), 3: (29_997, 3)}
