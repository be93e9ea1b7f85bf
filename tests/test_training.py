import json

import pytest
from pyspark.sql import functions as F

from plumbline import cases, cli
from plumbline.plans import training
from plumbline.sources.files import Settings

#: Places of the mistakes in the typed-in answers.
WRONG = {"p2": "десять лет", "p3": "500 рублей", "p6": "Погода сегодня хорошая, а завтра будет дождь и сильный ветер с моря", "p7": "премия 5000 рублей ежегодно"}


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(p, c, a, [[a.index(WRONG[p]), a.index(WRONG[p]) + len(WRONG[p]), 1]] if p in WRONG else [[0, min(3, len(a)), 0]]) for p, c, a in cases.PAIRS]
    return spark.createDataFrame(rows, "pair_id string, context string, answer string, labels array<array<int>>")


def test_trained_settings_are_no_worse(spark, pairs):
    own = training.trained(pairs, step=2, max_fpr=0.5)
    assert abs(sum(own.weights.values()) - 1) < 1e-9 and 0 < own.threshold < 1 and own.span_floor < own.span_cap
    rows = {r["level"]: r for r in training.evaluated(pairs, own).collect()}
    assert set(rows) == {"token", "answer", "verdict"}
    assert rows["token"]["tp"] + rows["token"]["fn"] > 5 and rows["answer"]["tp"] + rows["answer"]["fn"] == 4
    assert rows["answer"]["f1"] >= 0.5


def test_calibration_and_spans(spark, pairs):
    steps = training.calibrated(pairs)
    assert list(steps.values) == sorted(steps.values) and 0 <= min(steps.values) <= max(steps.values) <= 1
    quality = training.span_quality(pairs, Settings(expansion="mask")).first()
    assert quality["there"] == 4 and quality["said"] > 0


def test_commands(spark, pairs, tmp_path, capsys):
    path = tmp_path / "pairs.jsonl"
    path.write_text("\n".join(json.dumps({"id": r["pair_id"], "context": r["context"], "answer": r["answer"], "labels": r["labels"]}, ensure_ascii=False) for r in pairs.collect()), encoding="utf-8")
    assert cli.main(["selftest"], spark) == 0 and capsys.readouterr().out.strip() == "ok"
    for command in ("verify", "features", "tokens"):
        assert cli.main([command, str(path), "--out", str(tmp_path / command)], spark) == 0
    verdicts = {r["pair_id"]: r["verdict"] for r in spark.read.json(str(tmp_path / "verify")).collect()}
    assert verdicts["p1"] == "grounded" and len(verdicts) == 9
    assert spark.read.json(str(tmp_path / "tokens")).where(F.col("flagged")).count() > 0
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)
