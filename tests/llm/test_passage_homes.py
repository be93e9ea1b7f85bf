"""Homes of seeds that stand in several surroundings."""

import random

import numpy as np

from plumbline.llm.passages import led, repeated_passages


def test_a_passage_whose_words_stand_among_others_in_earlier_documents(spark):
    """Each run of nine words of the passage stands in an earlier document, among other words."""
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], []
    for _ in range(6):
        words = text(60)
        docs.append([w for at in range(0, 56, 4) for w in [*text(30), *words[at : at + 9]]] + text(30))
        docs += [text(40) + words + text(40) for _ in range(2)]
        want.append((len(docs) - 1, len(docs) - 2))
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["other_doc"]) for r in got if r["n_words"] >= 50) == want


def test_leaders():
    a, b = (0xFFFF << 32) | 0xFFFF, (0xFFFF0000 << 32) | 0xFFFF0000
    h, doc, near = np.array([1, 1, 1, 1, 2, 2]), np.array([3, 4, 5, 5, 3, 3]), np.array([a, b, a, b, a, a], np.uint64).view(np.int64)
    rows, homes, leaders = led(h, doc, near)
    assert sorted(zip(rows.tolist(), homes.tolist(), strict=True)) == [(2, 0), (3, 1)] and sorted(leaders.tolist()) == [0, 1, 4]
