import duckdb
import pytest

from plumbline.llm.mixing import budgets, mixed_documents, mixed_sources, mixing_sql

COLUMNS = "doc_id long, text string, lang string, source string, epoch long, key string, part double"


def rows_of(n=900):
    langs = ["en", "en", "en", "de", "fr", "es", "xx", None]
    out = []
    for i in range(n):
        source = "src0" if i % 3 == 0 else f"src{i % 11}" if i % 7 else None if i % 2 else "plain"
        text = None if i % 97 == 0 else "" if i % 89 == 0 else " ".join(["w"] * (i % 23 + 1))
        out.append((i, text, langs[i % 8], source, 1, "k", 0.5))
    return out


@pytest.mark.parametrize(("fraction", "epochs"), [(0.5, 2), (0.1, 1), (1.6, 3), (5.0, 2), (0.0, 2)])
def test_equals_sql(spark, fraction, epochs):
    rows = rows_of()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = sorted(tuple(r[c] for c in ("doc_id", "domain", "lang", "source", "epoch", "n_tokens")) for r in mixed_sources(docs, fraction=fraction, epochs=epochs).collect())
    con = duckdb.connect()
    con.register("rows", docs.toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM rows")
    want = sorted(con.sql("SELECT doc_id, domain, lang, source, epoch, n_tokens FROM (" + mixing_sql(fraction, epochs) + ")").fetchall())
    assert got == want


def brute_fill(budget, children):
    """Deal by weight, again and again, until no child is over its capacity."""
    part, open_ = dict.fromkeys(children, 0.0), {c for c, (w, cap) in children.items() if w > 0 and cap > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[c][0] for c in open_)
        full = {c for c in open_ if left * children[c][0] / total >= children[c][1] - 1e-12}
        if not full:
            for c in open_:
                part[c] = left * children[c][0] / total
            return part
        for c in full:
            part[c] = children[c][1]
        left -= sum(children[c][1] for c in full)
        open_ -= full
    return part


def test_shortages_go_to_siblings_first(spark):
    leaves = [("web", "en", "a1", 10, 1), ("web", "en", "a2", 1000, 1), ("web", "de", "b1", 500, 1), ("books", "en", "c5", 40, 1), ("code", "en", "d8", 5000, 1)]
    got = {r["source"]: r["part"] for r in budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, n_docs long"), fraction=0.2, epochs=1).collect()}
    total = int(sum(x[3] for x in leaves) * 0.2)
    tops = brute_fill(total, {"web": (0.5, 1510), "books": (0.3, 40), "code": (0.15, 5000)})
    langs = brute_fill(tops["web"], {"en": (0.5, 1010), "de": (0.2, 500)})
    ens = brute_fill(langs["en"], {"a1": (1, 10), "a2": (1, 1000)})
    assert got["c5"] == 40 and got["a1"] == 10
    for k, v in {"a1": ens["a1"], "a2": ens["a2"], "b1": langs["de"], "d8": tops["code"]}.items():
        assert abs(got[k] - v) < 1e-6
    assert abs(sum(got.values()) - total) < 1e-6


def test_prefixes_stay_within_budget_and_epochs(spark):
    docs = spark.createDataFrame(rows_of(), COLUMNS)
    got = mixed_sources(docs, fraction=0.5, epochs=2).collect()
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    assert {r["epoch"] for r in got} <= {0, 1}
    assert sum(r["n_tokens"] for r in got) <= 0.5 * sum(len((r[1] or "").split()) for r in rows_of())


def test_empty_table_and_ties(spark):
    docs = spark.createDataFrame(rows_of(3), COLUMNS)
    assert mixed_sources(docs.limit(0)).collect() == []
    same = spark.createDataFrame([(7, "a b", "en", "src1", 1, "k", 0.1)] * 6 + [(None, "a", "en", "src1", 1, "k", 0.1)], COLUMNS)
    assert sum(r["n_tokens"] for r in mixed_sources(same, fraction=0.5, epochs=1).collect()) <= 6


def test_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([*rows_of(), (7000, "w " * 60_000, "en", "src1", 3, "k", 0.1)], COLUMNS)
    out = mixed_documents(docs)
    assert out.columns == [*docs.columns, "domain", "epoch_", "n_tokens"]
    want = sorted(tuple(map(str, r)) for r in mixed_sources(docs).select("doc_id", "epoch", "n_tokens", "domain").collect())
    assert sorted(tuple(map(str, r)) for r in out.select("doc_id", "epoch_", "n_tokens", "domain").collect()) == want
    texts = {r[0]: r[1:] for r in rows_of()} | {7000: ("w " * 60_000, "en", "src1", 3, "k", 0.1)}
    assert all(tuple(r)[1:7] == texts[r["doc_id"]] for r in out.collect())
    assert mixed_documents(docs.limit(0)).collect() == []
