import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration, detector, heads, metrics, retrieval, sequence, spans, splits, vectors
from plumbline.sources import pairs as src


def test_smoothing_and_islands(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 1.0, 0.0, 0.0])] + [("b", 0, 0.5), ("b", 1, 0.7)], "k string, i int, v double")
    got = {(r["k"], r["i"]): r["s"] for r in sequence.smoothed(rows, "k", "i", "v", "s").collect()}
    assert got["a", 0] == pytest.approx(0.25) and got["a", 1] == pytest.approx(0.6) and got["b", 1] == 0.7
    runs = sequence.islands(rows.where("i <> 2"), "k", "i").groupBy("k", "island").count().collect()
    assert sorted((r["k"], r["count"]) for r in runs) == [("a", 1), ("a", 2), ("b", 2)]


def test_hysteresis(spark):
    risks = [0.1, 0.5, 0.9, 0.6, 0.1, 0.5, 0.6]
    rows = spark.createDataFrame([("a", i, r, True) for i, r in enumerate(risks)], "k string, i int, r double, s boolean")
    kept = sequence.hysteresis(rows, "k", "i", "r", "s", low=0.4, high=0.8, bridge=0, least=1)
    assert {r["i"] for r in kept.collect()} == {1, 2, 3}
    gap = spark.createDataFrame([("a", 0, 0.9, True), ("a", 1, 0.0, False), ("a", 2, 0.9, True)], "k string, i int, r double, s boolean")
    for bridge, parts in ((1, 1), (0, 2)):
        out = sequence.hysteresis(gap, "k", "i", "r", "s", low=0.4, high=0.8, bridge=bridge, least=1)
        assert out.select("component").distinct().count() == parts


def test_merged_intervals_equal_brute_force(spark):
    rng = random.Random(731)
    rows = [("k", s, s + rng.randrange(1, 9)) for s in (rng.randrange(300) for _ in range(60))]
    covered = {p for _, s, e in rows for p in range(s, e)}
    out = sequence.merged(spark.createDataFrame(rows, "k string, start int, end int"), ["k"]).collect()
    assert {p for r in out for p in range(r["start"], r["end"])} == covered and sum(r["parts"] for r in out) == 60
    assert all(r["end"] not in covered for r in out)


def test_auc_counts_ties_as_half(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6) / 5, rng.randrange(2)) for _ in range(80)]
    got = metrics.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))


def test_span_f1_and_containment(spark):
    said = spark.createDataFrame([("a", 0, 10), ("a", 20, 30), ("b", 0, 4)], "k string, start int, end int")
    gold = spark.createDataFrame([("a", 0, 9), ("a", 40, 50), ("c", 1, 2)], "k string, start int, end int")
    r = metrics.span_f1(said, gold, "k").first()
    assert (r["hit"], r["said"], r["there"]) == (1, 3, 3) and r["f1"] == pytest.approx(1 / 3)
    assert spans.containment(said, gold, "k").first()["contained"] == pytest.approx(1 / 3)
    assert {r["start"] for r in spans.overlapping(said, gold, "k").collect()} == {0}


def test_isotonic(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "s double, y int")
    steps = calibration.isotonic(rows, "s", "y")
    assert [steps.at(x) for x in (0.1, 0.2, 0.3, 0.4)] == [0, 0.5, 0.5, 1]
    two = calibration.pooled([(0.1, 0, 1), (0.3, 1, 1), (0.4, 1, 1)])
    assert [two.at(x) for x in (0, 0.1, 0.2, 0.3, 0.4, 0.5)] == [0, 0, 1, 1, 1, 1]
    got = rows.select(steps.column(F.col("s")).alias("v")).collect()
    assert [r["v"] for r in got] == [0, 0.5, 0.5, 1]


def test_matches_and_rouge(spark):
    rows = spark.createDataFrame([(["a"], ["a"]), (["a", "b"], ["a"])], "p array<string>, r array<string>")
    m = metrics.set_match(rows, "p", "r").first()
    assert (m["accuracy"], m["jaccard"], m["hamming"]) == (0.5, 0.75, 0.25)
    pair = spark.createDataFrame([(1, "abcab", "abab")], "k int, a string, b string")
    assert metrics.rouge_n(pair, "k", "a", "b", 1).first()["rouge"] == pytest.approx(2 * 4 / 9)


def test_chunks_cover_and_overlap(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(80))
    out = retrieval.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "d int, t string"), "d", "t", most_tokens=60).where("d = 1").orderBy("chunk").collect()
    assert all(text[r["start"] : r["end"]] == r["text"] for r in out) and len(out) > 3
    assert out[0]["start"] == 0 and out[-1]["end"] == len(text) and all(b["start"] < a["end"] for a, b in zip(out, out[1:], strict=False))


def test_splits(spark):
    rows = spark.range(200).select("id", (F.col("id") % 23).alias("g"))
    out = splits.ratio_split(rows, "g", {"train": 0.7, "test": 0.3})
    assert splits.shared_groups(out, "g", "split").count() == 0 and out.count() == 200
    assert splits.folds(rows, F.col("g"), 5).groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert splits.sample(rows, "id", 10).collect() == splits.sample(rows.repartition(7), "id", 10).collect()


def test_nearest_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (4096, 3):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.nearest(rows.where("vec_id % 10 = 0"), rows, 4, block=block).collect()}
        for q in range(0, 60, 10):
            order = [i for i in np.argsort(-(u @ u[q])) if i != q][:4]
            assert [got[q, k + 1] for k in range(4)] == order


def test_heads(spark):
    rows = spark.createDataFrame([(0.2, 1.0), (0.9, 0.0)], "a double, b double")
    node = {"feature": 0, "threshold": 0.5, "left": {"value": -1}, "right": {"feature": 1, "threshold": 0.5, "left": {"value": 2}, "right": {"value": 3}}}
    got = [r[0] for r in rows.select(heads.tree(node, ["a", "b"])).collect()]
    assert got == [-1, 2] and len(heads.weight_grid(10, list("abcde"))) == 1001
    p = rows.select(heads.logistic(["a", "b"], [0, 0], [1, 1], [1, 2], 0.5)).collect()
    assert p[0][0] == pytest.approx(1 / (1 + np.exp(-2.7)))


def test_detector_finds_even_text(spark):
    flat = "данный метод обеспечивает эффективность " * 20
    rows = spark.createDataFrame([("x", flat), ("y", "Я вчера встретил необыкновенно шумного кота у реки, а он ушёл")], "id string, t string")
    got = {r["id"]: r["score"] for r in detector.analyze(rows, "id", "t").collect()}
    assert got["x"] > got["y"]


def test_pairs_are_read_and_checked(spark, tmp_path):
    good = '{"id": "1", "context": "c", "answer": "abc", "labels": [[0, 2, 1]], "meta": {"k": "v"}}'
    bad = ['{"context": "c", "answer": "abc", "labels": [[0, 9, 1]]}', '{"context": "c", "answer": "a", "extra": 1}', "nonsense", '{"answer": "a"}']
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join([good, "", *bad]), encoding="utf-8")
    rows = src.read_pairs(spark, str(path), strict=False).collect()
    assert sorted(len(r["reasons"]) > 0 for r in rows) == [False, True, True, True, True]
    with pytest.raises(Exception, match="bad pair"):
        src.read_pairs(spark, str(path)).collect()
    path.write_text(good, encoding="utf-8")
    src.write_pairs(src.read_pairs(spark, str(path)), str(tmp_path / "out"))
    assert src.read_pairs(spark, str(tmp_path / "out")).first()["answer"] == "abc"


def test_stream_of_pairs(spark, tmp_path):
    from plumbline.streaming.verify import pair_stream, verify_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"pair_id": "1", "context": "alpha beta gamma", "answer": "alpha beta"}\n')
    verify_stream(pair_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["verdict"] == "grounded"


def test_bootstrap_runs_the_replicates_of_the_reference(spark):
    rows = spark.createDataFrame([(i / 40, int(i * 7 % 40 > 22), f"c{i}") for i in range(40)], "score double, label int, key string")
    assert metrics.bootstrap_auc(rows, "score", "label", "key").collect()[0]["replicates"] == 5000
