import pytest

from plumbline.operators import features as ft
from plumbline.functions import normalize
from plumbline.operators import coverage
from plumbline.plans import verify as vf

CONTEXT = "Срок хранения первичных документов составляет пять лет. Срок хранения вторичных документов составляет десять лет."


def pairs(spark, *answers, context=CONTEXT):
    return spark.createDataFrame([(str(i), context, a) for i, a in enumerate(answers)], "pair_id string, context string, answer string")


def test_measurements(spark):
    got = {(r["value"], tuple(r["subject"])) for r in ft.measurements(pairs(spark, "x")).collect()}
    assert {v for v, _ in got} == {"5", "10"}
    assert ("5", ("срок", "хранения", "первичных", "документов")) in got


def test_number_of_another_subject_is_borrowed(spark):
    rows = pairs(spark, "Срок хранения первичных документов составляет десять лет.", "Срок хранения первичных документов составляет пять лет.")
    got = [(r["pair_id"], r["value"], r["matched_value"]) for r in ft.attributions(rows).collect()]
    assert got == [("0", "10", "5")]
    verdicts = {r["pair_id"]: r["verdict"] for r in vf.verify(rows).collect()}
    assert verdicts["0"] == "doubtful" and verdicts["1"] == "grounded"


def test_empty_and_unrelated_answers(spark):
    rows = pairs(spark, "", "   ", "Квантовая запутанность фотонов наблюдается экспериментально повсюду.", None)
    got = {r["pair_id"]: (r["verdict"], r["n_tokens"]) for r in vf.verify(rows).collect()}
    assert got["0"] == got["1"] == got["3"] == ("empty", 0) and got["2"][0] != "grounded"


def test_number_runs_share_a_value(spark):
    toks = ft.number_groups(ft.tx.tokens(pairs(spark, "всего двадцать пять лет и 1 000 дней, сто двадцать"), ["pair_id"], "answer"))
    got = [(r["text"].strip(), r["value"]) for r in toks.orderBy("idx").collect() if r["value"]]
    assert got == [("двадцать", "25"), ("пять", "25"), ("1", "1000"), ("000", "1000"), ("сто", "120"), ("двадцать", "120")]


def test_similarities_equal_exhaustive_search(spark):
    context, answer = "хранение хранение сроков документы документации отчёт", "хранения документ срочный отчёты xyz"
    p = pairs(spark, answer, context=context)
    asked, known = ft.vocabulary(p, "answer"), ft.vocabulary(p, "context")
    got = {r["word"]: r for r in ft.supports(asked, known, ft.similarities(asked, known, 3)).collect()}

    def grams(w):
        w = "^" + w.replace("ё", "е") + "$"
        return {w[i : i + 3] for i in range(max(1, len(w) - 2))}

    for w in answer.replace("ё", "е").split():
        scores = sorted((len(grams(w) & grams(c)) / len(grams(w) | grams(c)) for c in context.split()), reverse=True)
        assert got[w]["max_sim"] == pytest.approx(scores[0])
        assert got[w]["top_mean"] == pytest.approx(sum(scores[:3]) / 3)
        same = any(c.replace("ё", "е")[:4] == w[:4] for c in context.split())
        assert got[w]["support"] == pytest.approx(1.0 if same else 0.7 * scores[0])


def test_units_dates_and_coverage(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("срок 5 лет, 10 %, подписан 24 июня 2025 г. и 1.2.25",)], "t string")
    assert row.select(normalize.normalized_dates(F.col("t"))).first()[0] == "срок 5 лет, 10 %, подписан 24.06.2025 и 01.02.2025"
    assert row.select(normalize.normalized_units(F.col("t"))).first()[0].startswith("срок 5 год, 10 процент")
    got = {r["value"]: r["status"] for r in coverage.coverage(pairs(spark, "Архив хранит отчёты 5 лет.", context="Архив хранит отчёты ровно 5 лет. Склад держит запасы масла около 30 дней.")).collect()}
    assert got["5 лет"] == "mentioned" and got["30 дней"] == "irrelevant"


def test_the_entry_needs_no_session_to_be_imported():
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 150"], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
