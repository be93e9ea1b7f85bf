import math
import re
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import cases
from plumbline.operators import calibration, candidates, coverage, evaluation, learning, retrieval, vectors
from plumbline.operators import labels as lb
from plumbline.operators import shaping as sh
from plumbline.plans import verify as vf
from plumbline.sources import external, files


def test_verdicts_of_the_typed_in_pairs(spark):
    got = {r["pair_id"]: (r["verdict"], {s["source"] for s in r["spans"]}) for r in vf.verified(cases.pairs(spark)).collect()}
    assert got["p1"][0] == "grounded" and got["p9"][0] == "empty"
    # A number of another subject, a changed value, an omission and a condition left out are found by rules.
    for pair in ("p2", "p3", "p4", "p5"):
        assert got[pair][0] != "grounded" and got[pair][1] & {"attribution", "coverage", "rule"}, pair


def test_statuses_of_facts(spark):
    got = {(r["pair_id"], r["sentence"]): r["status"] for r in coverage.coverage(cases.pairs(spark)).collect()}
    assert got["p1", 0] == "mentioned" and got["p3", 0] == "distorted" and got["p4", 0] == "partial" and got["p5", 0] == "omitted" and got["p6", 0] == "irrelevant"


def test_facts_beyond_the_first_sixty_are_had_on_demand(spark):
    text = " ".join(f"Срок хранения документа номер составляет {i} дней." for i in range(1, 91))
    rows = spark.createDataFrame([("a", text, "x")], "pair_id string, context string, answer string")
    assert coverage.facts(rows).count() == 60 and coverage.facts(rows, most=None).count() == 90


def test_gradient_descent_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=80) > 0).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y int")
    got = learning.logistic(rows, ["a", "b", "c"], "y", epochs=25)
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.zeros(3), 0.0
    for _ in range(25):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.5 * (z.T @ e / 80 + 1e-3 * w), b - 0.5 * e.mean()
    assert np.allclose(got.weights, w) and math.isclose(got.bias, b)
    assert learning.Linear.from_dict(got.to_dict()) == got
    assert learning.logistic(rows.limit(0), ["a"], "y", epochs=2).weights == (0.0,)
    with pytest.raises(ValueError):
        learning.Linear.from_dict({**got.to_dict(), "scales": [0.0, 1.0, 1.0]})
    assert abs(learning.logistic(rows, ["a", "b", "c"], "y", epochs=25, balanced=True).bias - got.bias) > 0


def test_out_of_fold_rows_are_judged_once(spark):
    rows = spark.range(90).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).alias("y"), (F.col("id") % 3).alias("fold"))
    assert learning.out_of_fold(rows, ["a"], "y", "fold", 3, epochs=2).select("id").distinct().count() == 90
    with pytest.raises(ValueError):
        learning.fold_receipts(rows.withColumn("g", F.col("id") % 2), "g", "fold")


def plain_cuts(text, most, overlap):
    out, at = [], 0
    ends = [m.end() for m in re.finditer(r"(?<=[.!?…])[ \t]+(?=[«\"(]?[A-ZА-ЯЁ0-9])", text)]
    while True:
        end = min(at + most, len(text))
        if end < len(text):
            inside = [e for e in ends if at < e <= end - 1]
            blanks = [i for i in range(max(at + 1, at + most // 2), end) if text[i] == " "]
            end = inside[-1] if inside else blanks[-1] if blanks else end
        out.append((at, end))
        if end >= len(text):
            return out
        at = max(end - overlap, at + 1)


def test_long_segments(spark):
    texts = ["short", "One two. " * 300, "word " * 900, "x" * 5000, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in retrieval.long_parts(rows, "id", "text").orderBy("id", "part").collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"]))
    for i, text in enumerate(texts):
        assert got[i] == (plain_cuts(text, retrieval.LONG, retrieval.SHARED) if len(text) > retrieval.LONG else [(0, len(text))]), i


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([("a", i, w) for i, w in enumerate(["Ёлка", "и", "дом"])], "k string, i int, word string")
    got = {r["i"]: r["vector"] for r in vectors.hashed_vectors(rows, "k", "i", 64).collect()}
    at = lambda x: int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "big") % 64
    want = {}
    for name, weight in [("w:и", 1.0), ("g:^и$", 0.35), ("p:елка", 0.25), ("n:дом", 0.25)]:
        want[at(name)] = want.get(at(name), 0) + weight
    norm = math.sqrt(sum(v * v for v in want.values()))
    assert got[1] == pytest.approx({k: v / norm for k, v in want.items()})
    assert all(sum(v * v for v in x.values()) == pytest.approx(1) for x in got.values())


def test_cross_validation_and_shares(spark):
    rows = spark.range(200).select((F.col("id") / 200).alias("s"), (F.col("id") % 10 < F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 4).alias("fold"))
    out = evaluation.cross_validated(rows, "s", "y", "fold", 4, 0.3).collect()
    assert len(out) == 4 and sum(r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in out) == 200
    steps, done = evaluation.calibrated_shares(rows.withColumn("t", F.col("y").cast("double")), "s", "t")
    assert isinstance(steps, calibration.Steps) and list(steps.values) == sorted(steps.values)
    values = [r["calibrated"] for r in done.orderBy("s").collect()]
    assert values == sorted(values)
    with pytest.raises(ValueError):
        evaluation.calibrated_shares(rows.withColumn("t", F.lit(2.0)), "s", "t")


@pytest.mark.parametrize(("target", "least"), [(1500, 40), (120, 40), (10, 40), (700, 150)])
def test_quotas(target, least):
    mix = {"clean": 0.4, "swap": 0.2, "omission": 0.15, "invention": 0.15, "shift": 0.1}
    got = evaluation.quotas(target, mix, "clean", least)
    assert sum(got.values()) == target and got["clean"] >= round(0.4 * target) and min(got.values()) >= 1
    if target - round(0.4 * target) >= 4 * least:
        assert min(got.values()) >= least


def test_the_rule_grid_has_every_cell(spark):
    rows = spark.createDataFrame([(0.1, 0.5, 5, 90, 0, 1, 20, 1), (0.1, 0.5, 3, 10, 0, 1, 20, 0)], "score double, threshold double, mask_tokens int, max_fragment_chars int, text_spans int, mask_spans int, scored_tokens int, y int")
    cells = evaluation.rule_grid(rows, "y")
    assert cells.count() == 810
    best = evaluation.chosen(cells, 0.1).first()
    assert (best["tp"], best["fp"], best["stage"]) == (1, 0, 1) and best["min_mask_tokens"] == 5


def test_generators_decoders_and_filters_are_checked():
    assert candidates.checked_generator(0.3, 0.6, 2, 1)["low"] == 0.3 and candidates.checked_decoder(0.5, 3.0)["high"] == 3.0
    head = {"mean": [0.0] * 19, "scale": [1.0] * 19, "coef": [0.0] * 19, "intercept": 0.0}
    assert candidates.checked_filter(head, 0.5)["keep"] == 0.5
    for bad in (lambda: candidates.checked_generator(0.7, 0.6, 0, 1), lambda: candidates.checked_decoder(0.1, math.inf), lambda: candidates.checked_filter({**head, "scale": [0.0] * 19}, 0.5), lambda: candidates.checked_filter({**head, "coef": [1.0]}, 0.5)):
        with pytest.raises(ValueError):
            bad()


def test_localized_spans_count_their_tokens_anew(spark):
    answers = spark.createDataFrame([("a", "one two three four")], "pair_id string, answer string")
    spans = spark.createDataFrame([("a", 0, 7, "", 0.4, "doubtful", 9, "mask"), ("a", 4, 13, "", 0.8, "likely_hallucination", 9, "attribution")], sh.SPAN)
    tokens = spark.createDataFrame([("a", 0, 4), ("a", 4, 8), ("a", 8, 14), ("a", 14, 18)], "pair_id string, start int, end int")
    (r,) = candidates.localized(spans, answers, tokens).collect()
    assert (r["text"], r["n_tokens"], r["sources"], r["source"], r["label"]) == ("one two three", 3, ["attribution", "mask"], "rule", "likely_hallucination")


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        sh.verdict("none")
    with pytest.raises(ValueError):
        lb.labelled(spark.createDataFrame([], "answer_id string, doc_id string, answer string"), spark.createDataFrame([], "doc_id string, text string"), mode="x")
    with pytest.raises(ValueError):
        files.Settings.of({"nothing": 1})


def test_settings_and_models_in_files(spark, tmp_path):
    own = files.Settings.of({"threshold": 0.4, "rule": "any_span"})
    files.write_settings(spark, own, str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("part-*")
    assert files.read_settings(spark, str(part)) == own
    (tmp_path / "m.json").write_text('{"weights": [1], "bias": 0}')
    assert files.read_model(spark, str(tmp_path / "m.json"), ("weights", "bias"))["bias"] == 0
    with pytest.raises(ValueError):
        files.read_model(spark, str(tmp_path / "m.json"), ("means",))
    (tmp_path / "sources.json").write_text('{"documents": {"a": {"url": "u", "text_sha256": "x"}}}')
    manifest = files.read_manifest(spark, str(tmp_path / "sources.json"))
    assert manifest.count() == 1
    texts = spark.createDataFrame([("a", "t")], "id string, text string")
    assert [tuple(r) for r in files.hash_problems(manifest, texts).collect()] == [("a", "changed")]
    assert files.hash_problems(manifest, texts.limit(0)).first()["problem"] == "missing"


def test_a_cache_with_an_empty_list_fails_when_strict(spark, tmp_path):
    row = '{"key": "k", "pair_id": "p", "max_length": 1, "chunked": false, "entropy": [1.0], "mass": [%s], "mass_norm": [1.0], "max_sim": [1.0], "density": [1.0]}'
    (tmp_path / "features_0.jsonl").write_text(row % "" + "\n")
    assert files.read_feature_cache(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="no values of mass"):
        files.read_feature_cache(spark, str(tmp_path), strict=True).collect()
    (tmp_path / "features_1.jsonl").write_text(row % "2.0" + "\n")
    assert files.read_feature_cache(spark, str(tmp_path), strict=True).first()["mass"] == [2.0]


def test_responses_without_a_source_fail(spark):
    responses = spark.createDataFrame([(1, "s", "text", [], "m", "train", "good")], "id int, source_id string, response string, labels array<struct<start:int,end:int,text:string,label_type:string>>, model string, split string, quality string")
    sources = spark.createDataFrame([("other", "QA", '"c"')], "source_id string, task_type string, source_info string")
    with pytest.raises(Exception, match="no source"):
        external.response_pairs(responses, sources).collect()
    row = spark.createDataFrame([("The cat", external.annotation_of([("dog", "x")]))], "t string, a string")
    with pytest.raises(Exception, match="not in the answer"):
        row.select(external.found_spans(F.col("t"), F.col("a"), True)).collect()
