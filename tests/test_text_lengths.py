"""Lengths of whole text files, read in blocks of lines."""

import random

from pyspark.sql import functions as F

from plumbline import queries_sources
from plumbline.sources import files


def lengths(rows):
    return sorted((r["id"], r["synthetic"], r["n_chars"]) for r in rows)


def test_lengths_are_those_of_the_whole_texts(spark, tmp_path):
    rng = random.Random(8)
    parts = ["\n", "\n", "\r\n", "\r", " ", "\t", "\xa0", "\xad", "word", "ё", "\n\n", " \n ", "😀", "a b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += ["", " \r\n\t", "\xad\n\xad", "x", "\r\r\na\r", "\n" * 70 + "a" + "\n" * 70]
    for kind in ("generated", "real"):
        (tmp_path / kind).mkdir()
        for i, t in enumerate(texts):
            (tmp_path / kind / f"t{i}.txt").write_bytes(t.encode())
    want = lengths(files.read_texts(spark, str(tmp_path)).select("id", "synthetic", F.length("text").alias("n_chars")).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "25b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert lengths(files.text_lengths(spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_row_holds_a_language(spark, tmp_path, monkeypatch):
    """A file's rows are in the order of their ids, and none of the plans gathers texts in a row."""
    rows = [(i, f"{i:05d} " + "x" * (i % 7), "en" if i % 3 else "ru", "s") for i in range(4000)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries_sources, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    out = queries_sources.text_files(spark, str(tmp_path))
    for kind in ("generated", "real"):
        for lang, least in (("en", 1), ("ru", 0)):
            (file,) = (tmp_path / "texts" / kind / f"lang={lang}").glob("*.txt")
            assert [int(line[:5]) for line in file.read_text().splitlines()] == [i for i in range(4000) if (i % 3 > 0) == least]
    assert "collect_list(struct(doc_id" not in out._jdf.queryExecution().toString() and "wholetext" not in out._jdf.queryExecution().toString().lower()
    assert len(out.collect()) == 4
