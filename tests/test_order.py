"""Results that must not hang on the order in which rows are computed."""

import os
import random

from plumbline.operators import shaping


def test_clauses_of_spans_whose_order_changes(spark):
    """Rows that come in another order each time they are computed keep their own ends."""
    answer = "alpha one, beta two; gamma three, delta four, epsilon five; zeta six, eta seven, theta eight"
    rng = random.Random(3)
    words = [(m, m + len(w)) for w in answer.replace(",", "").replace(";", "").split() for m in [answer.index(w)]]
    rows = [(f"p{i}", *w, *w) for i in range(40) for w in rng.sample(words, 3)]
    spans = spark.createDataFrame([(*r, 0.5) for r in rows], "pair_id string, start int, end int, keep_start int, keep_end int, risk double").coalesce(1)
    answers = spark.createDataFrame([(f"p{i}", answer) for i in range(40)], "pair_id string, answer string")

    def mixed(batches):
        for b in batches:
            yield b.sample(frac=1, random_state=int.from_bytes(os.urandom(4)))

    out = shaping.clauses(spans.mapInPandas(mixed, spans.schema), answers).collect()
    assert len(out) == len(rows)
    for r in out:
        left = max(answer.rfind(",", 0, r["keep_start"]), answer.rfind(";", 0, r["keep_start"])) + 1
        stops = [at for at in (answer.find(s, r["keep_end"]) for s in ",;") if at >= 0]
        assert (r["start"], r["end"]) == (left, min(stops, default=len(answer)))
