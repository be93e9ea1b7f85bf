import math
import random
from collections import Counter

from plumbline.llm.decontamination import leaks, without_leaks


def grams(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items, least=0.8, k=5):
    usable = [(i, (t or "").lower().split()) for i, t in items]
    usable = [(i, w) for i, w in usable if w]
    df = Counter(g for _, w in usable for g in set(grams(w, min(k, len(w)))))
    weight = lambda g: 1 + math.log(len(usable) / max(1, df[g]))
    out = {}
    for d, t in docs:
        words = (t or "").lower().split()
        for i, w in usable:
            a = grams(w, min(k, len(w)))
            for s in range(len(words) - len(w) + 1):
                b = grams(words[s : s + len(w)], min(k, len(w)))
                keys = a.keys() | b.keys()
                j = sum(min(a[g], b[g]) * weight(g) for g in keys) / sum(max(a[g], b[g]) * weight(g) for g in keys)
                if j >= least - 1e-9:
                    out[d, i] = max(out.get((d, i), (0, 0)), (round(j, 9), -s))
    return out


def corpus():
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([5, 8, 15, 30, 55])))) for i in range(14)] + [(20, None), (21, ""), (22, "V1 v2 v3"), (24, "v7"), (25, "v5 v5"), (26, "  \n"), (23, "v1 " * 12)]
    docs = []
    for d in range(40):
        words = text(rng.choice([0, 3, 40, 200]))
        if d % 3 == 0:
            own = rng.choice(items[:14])[1].split()
            if d % 2 and len(own) > 20:
                own[rng.choice([0, len(own) - 1])] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((d, rng.choice([" ", "\n"]).join(words).upper()))
    return docs + [(50, None), (51, "v1 " * 40)], items


def test_equals_brute_force(spark):
    docs, items = corpus()
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    for r in got:
        assert (round(r["similarity"], 6), -r["start_word"]) == (round(want[r["doc_id"], r["item_id"]][0], 6), want[r["doc_id"], r["item_id"]][1])


def test_items_in_blocks_give_the_same(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((r["doc_id"], r["item_id"], r["start_word"], r["hamming"], round(r["similarity"], 9)) for r in rows)
    assert key(leaks(d, b).collect()) == key(leaks(d, b, item_block=4).collect())


def test_long_documents_and_filter(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(["pad"] * 9000 + [item] + ["tail"] * 9000)
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, "pad " * 50, 6, "y"), (None, item, 7, "z"), (2, None, 8, "w")], "doc_id long, text string, item_id int, similarity string")
    benchmark = spark.createDataFrame([(1, item, 1)], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["start_word"], r["hamming"]) for r in leaks(docs, benchmark).collect()}
    assert got == {(1, 9000, 0), (None, 0, 0)}
    left = without_leaks(docs, benchmark)
    assert left.columns == docs.columns and sorted(r["item_id"] for r in left.collect()) == [6, 7, 8]
    assert leaks(docs.limit(0), benchmark).collect() == [] and leaks(docs, benchmark.limit(0)).collect() == []


def test_all_windows_at_the_similarity_are_found(spark):
    """Inner words changed, where fingerprints differ by many bits."""
    rng = random.Random(3)
    items = [(i, [f"q{rng.randrange(10**9)}" for _ in range(59)]) for i in range(300)]
    docs = []
    for i, words in items:
        words = list(words)
        words[rng.randrange(10, 49)] = "changed"
        docs.append((i, " ".join(["pad"] * 9 + words + ["tail"] * 9)))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start_word"]) for r in got) == [(i, i, 9) for i in range(300)]
    assert max(r["hamming"] for r in got) > 15


def test_document_that_is_a_cut_item(spark):
    words = [f"q{i}" for i in range(59)]
    docs = [(n, " ".join(words[:n])) for n in (4, 30, 47, 48, 57, 58, 59)] + [(100, " ".join(words[2:])), (101, " ".join(words[:58] + ["other"]))]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["start_word"], r["n_words"], round(r["similarity"], 4)) for r in got} == {
        48: (0, 48, 0.8), 57: (0, 57, round(53 / 55, 4)), 58: (0, 58, round(54 / 55, 4)), 59: (0, 59, 1.0), 100: (0, 57, round(53 / 55, 4)), 101: (0, 59, round(54 / 56, 4))}


def test_blocks_weigh_the_shingles_of_other_blocks(spark):
    """Windows that hold shingles shared by items of other blocks, near the similarity."""
    rng = random.Random(6)
    text = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    common = text(9)
    items = [(i, text(79)) for i in range(30)] + [(i, text(20) + common) for i in range(30, 36)]
    docs = [(i, " ".join(words[:70] + common)) for i, words in items[:30]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    key = lambda rows: sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in rows)
    assert key(leaks(d, b).collect()) == key(leaks(d, b, item_block=4).collect())
    assert {(r["doc_id"], r["item_id"]) for r in leaks(d, b, item_block=4).collect()} == set(brute(docs, [(i, " ".join(w)) for i, w in items]))


def test_windows_exactly_at_the_similarity(spark):
    """32 of 36 shingles each: 32 / 40 whatever the order of the sums, from word 3 on."""
    rng = random.Random(8)
    items = [(i, [f"q{rng.randrange(10**9)}" for _ in range(40)]) for i in range(200)]
    docs = [(i, " ".join(["pad"] * 7 + words[:36] + ["changed"] + words[37:] + ["tail"] * 5)) for i, words in items]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start_word"]) for r in got) == [(i, i, 3) for i in range(200)]
    assert all(abs(r["similarity"] - 0.8) < 1e-9 for r in got)


def test_recall_over_lengths(spark):
    """Every window at 0.8 or more, for items of 20, 40 and 80 words with up to three words changed."""
    rng = random.Random(12)
    items, docs = [], []
    for i in range(150):
        words = [f"q{rng.randrange(10**9)}" for _ in range((20, 40, 80)[i % 3])]
        items.append((i, " ".join(words)))
        for at in rng.sample(range(len(words)), rng.randrange(4)):
            words[at] = f"c{rng.randrange(10**9)}"
        docs.append((i, " ".join(["pad"] * 6 + words + ["tail"] * 6)))
    want = set(brute(docs, items))
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 50


def test_short_items(spark):
    docs = [(1, "it was the best of times"), (2, "the best of"), (3, "times of best the"), (4, None), (5, "best of Times and more words")]
    items = [(1, "Best of times"), (2, "the best of times"), (3, " "), (4, None)]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start_word"], r["n_words"], r["similarity"]) for r in got) == [(1, 1, 3, 3, 1.0), (1, 2, 2, 4, 1.0), (5, 1, 0, 3, 1.0)]
    clash = spark.createDataFrame([(1, "it was the best of times", 1), (2, "fine", 2)], "doc_id long, text string, gone int")
    left = without_leaks(clash, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == clash.columns and [r["doc_id"] for r in left.collect()] == [2]
