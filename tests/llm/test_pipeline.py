"""The pipeline against the brute-force versions of its stages, one after the other."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm.common import shared_folder
from plumbline.llm.mixing import mixing_sql
from plumbline.llm.toxicity import Model, Reader, learned
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_groups


def corpus():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([15, 30, 50]))) for i in range(6)]
    docs, family = [], [text(120) for _ in range(4)]
    for i in range(90):
        body = text(rng.choice([5, 60, 150]))
        if i % 9 == 0:
            body = family[i % 4] + (" v1" if i % 2 else "")
        if i % 13 == 0:
            body += "\n" + items[i % 6][1]
        if i % 10 == 3:
            body += "\nyou are an idiot and a moron. you idiot scum"
        if i % 2:
            body = "Common menu line\n" + body
        docs.append((i, body, rng.choice(["en", "de", "fr", None]), f"src{i % 4}" if i % 17 else None, len(body)))
    return [*docs, (90, None, "en", "src1", 0), (91, "", "en", "src1", 0), (92, "Common menu line", "en", "src1", 16)], items


@pytest.fixture
def folder(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 20, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_equals_brute_force(spark, folder):
    docs, items = corpus()
    model = learned(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert model == Model()
    reader = Reader(model)
    rows = [d for d in docs if model.score(*reader.clauses(d[1])[:2]) < 0.7]
    assert 5 < len(docs) - len(rows) < 30
    texts = {i: t for i, t, _, _ in brute_lines([(d[0], d[1], d[3]) for d in rows], 0.1, 3)}
    rows = [(d[0], texts[d[0]], *d[2:]) for d in rows]
    groups = brute_groups(texts, 5)
    rows = [d for d in rows if groups[d[0]][2]]
    gone = {d for d, _ in brute_leaks([(d[0], d[1]) for d in rows], items)}
    assert gone
    rows = [d for d in rows if d[0] not in gone]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(d) for d in rows])
    want = sorted(con.sql("SELECT doc_id, domain, lang, source, epoch, n_tokens FROM (" + mixing_sql() + ")").fetchall())
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "domain", "epoch", "n_tokens"]
    rows = {d[0]: d for d in rows}
    result = out.collect()
    got = sorted((r["doc_id"], r["domain"], r["lang"] or "", r["source"] or "", r["epoch"], r["n_tokens"]) for r in result)
    assert got == want and got
    assert all((r["text"], r["lang"], r["source"]) == rows[r["doc_id"]][1:4] and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in result)


def test_scratch_tables_are_deleted(spark, folder):
    base = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(base))
    out = corpus_pipeline.run(spark, folder)
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and out.count() > 0 and out.scratch_path.endswith(left.pop())


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert dict(docs.dtypes) == {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    assert docs.count() > 20
