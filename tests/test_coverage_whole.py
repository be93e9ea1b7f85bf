"""Facts beyond the first sixty of a pair."""

import __spark_entry__  # noqa: F401
from plumbline.operators import coverage
from tests.test_sql_parity import compared


def test_documents_are_covered_with_all_their_facts(spark, tmp_path):
    """Document 0 has 90 facts; document 1 tells the last one and changes that of another."""
    text = " ".join(f"Срок хранения документа номер {i} составляет {i} дней." for i in range(1, 90)) + " Гарантия завода действует ровно 24 месяца."
    docs = spark.createDataFrame([(0, text, "ru", "s"), (1, "Гарантия завода действует ровно 24 месяца. Срок хранения документа номер составляет 500 лет.", "ru", "s"), (2, text, "ru", "s")], "doc_id long, text string, lang string, source string")
    got, want = compared(spark, tmp_path, "document_coverage", documents=docs)
    assert got == want
    assert sum(n for pair, _, n in got if pair == "0") == 90 and ("0", "mentioned", 1) in got


def test_a_changed_value_of_the_last_of_many_facts_is_found(spark):
    """The 71st fact of a context has another value in the answer; verified() takes coverage() as it is."""
    text = " ".join(f"Срок хранения документа номер {i} составляет {i} дней." for i in range(1, 71)) + " Размер государственной пошлины составляет 350 рублей за каждый документ."
    pairs = spark.createDataFrame([("a", text, "Размер государственной пошлины составляет 500 рублей за каждый документ.")], "pair_id string, context string, answer string")
    found = {r["sentence"]: r["status"] for r in coverage.coverage(pairs).select("sentence", "status").collect()}
    assert len(found) == 71 and found[70] == "distorted"
