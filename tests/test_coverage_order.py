"""Coverage at size: what is cut and normalised, and how often."""

from plumbline.operators import coverage


def test_answers_meet_facts_as_rows_and_sentences_are_not_shuffled(spark):
    text = "Срок хранения документов в архиве составляет 5 лет. Второе предложение без чисел и без всяких значений."
    pairs = spark.createDataFrame([("a", text, text), ("b", "no value stands here at all", text), ("c", text, " "), ("d", text, "")], "pair_id string, context string, answer string")
    out = coverage.coverage(pairs)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["pair_id"], r["sentence"], r["start"], r["status"]) for r in out.collect()) == [("a", 0, 0, "mentioned"), ("c", 0, 0, "irrelevant")]
