import re

from pyspark.sql import functions as F

from plumbline.functions import text as tx


def values(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


TEXTS = ["Срок хранения — 5 лет, верно?", "  one-two  don't\nstop. ", "a b", "", None, "ё_x 10%", "..."]


def test_tokens_cover_the_text(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for i, text in enumerate(TEXTS):
        got = [(r["text"], r["start"], r["end"]) for r in tx.tokens(rows.where(f"i = {i}"), ["i"], "t").orderBy("idx").collect()]
        want = [(text[m.start() : m.end()], m.start(), m.end()) for m in re.finditer(r"(?:\w+(?:[-'’]\w+)*|[^\w\s])\s*", text or "")]
        assert got == want


def test_sentences_keep_offsets(spark):
    text = "Первое. Второе дело! «Третье»? четвёртое… 5 лет"
    rows = spark.createDataFrame([(1, text)], "i int, t string")
    got = [(r["start"], r["end"]) for r in tx.sentences(rows, ["i"], "t").orderBy("start").collect()]
    cuts = [0, *(m.end() for m in re.finditer(r"(?<=[.!?…])[ \t]+(?=[«\"(]?[A-ZА-ЯЁ0-9])", text)), len(text)]
    assert got == list(zip(cuts, cuts[1:], strict=False))


def test_scored_and_numbers(spark):
    words = ["и", "срок ", "5", "да", "нет", "пять", "007", "два,", ".", "abc"]
    assert values(spark, tx.is_scored(F.col("t")), words) == [False, True, True, False, False, True, True, False, False, True]
    assert values(spark, tx.number_value(tx.edge_word(F.col("t"))), words) == [None, None, "5", None, None, "5", "7", "2", None, None]


def test_grams_stems_and_counts(spark):
    assert values(spark, tx.grams(F.col("t")), ["Ёж", "a", ""]) == [["^еж", "еж$"], ["^a$"], []]
    assert values(spark, tx.stem(F.col("t")), ["Хранения,", "срок"]) == ["хран", "срок"]
    assert values(spark, tx.estimated_tokens(F.col("t")), ["", "ab", "x" * 27, None]) == [0, 1, 10, 0]
    assert values(spark, tx.first_place(F.col("t"), F.lit("пять лет")), ["срок пять лет, срок пять лет", "x"]) == [5, None]
    assert values(spark, tx.occurrences(F.col("t"), F.lit("пять лет")), ["срок пять лет, срок пять лет", "x"]) == [2, 0]


def test_markup(spark):
    page = '<p>a <b>b</b></p><script>x</script><a href="/u">l</a>'
    assert values(spark, tx.visible(F.col("t")), [page]) == ["a b l"]
    assert values(spark, tx.links(F.col("t")), [page]) == [["/u"]]
