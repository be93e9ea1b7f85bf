from collections import Counter, defaultdict

from plumbline.llm.line_dedup import without_boilerplate

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, host string, lines string, n_lines string"


def brute(rows, ratio, least):
    pages, held = Counter(), defaultdict(Counter)
    for _, text, source in rows:
        pages[source] += 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} if text is not None else ():
            if line:
                held[source][line] += 1
    out = []
    for i, text, source in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (held[source][x.strip(" \t\r")] >= least and held[source][x.strip(" \t\r")] > ratio * pages[source])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = [(i, f"Menu\nown line {i}\n\n  Menu \t\nshared {i % 3}\nFooter\r", "a") for i in range(12)]
    rows += [(i, "Menu\nFooter" if i % 2 else f"text {i}", "b") for i in range(20, 26)]
    rows += [(30, None, "a"), (31, "", "a"), (32, "Menu", None), (33, "Menu", None), (34, "Menu", None), (34, "Menu", None), (None, "Menu\nx", "a"), (40, "x" * 50_000 + "\nMenu", "a"), (50, "Menu", "lone")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, "h", "l", "n") for i, t, s in rows], COLUMNS).repartition(3)
    for ratio, least in ((0.1, 3), (0.4, 2), (0.9, 1)):
        got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in without_boilerplate(docs, ratio=ratio, least_pages=least, counts=True).collect()), key=str)
        assert got == brute(rows, ratio, least)


def test_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", "en", "s", 3, "h", "l", "keep")] * 4, COLUMNS)
    out = without_boilerplate(docs)
    assert out.columns == docs.columns and [(r["text"], r["n_lines"]) for r in out.collect()] == [("", "keep")] * 4
    assert without_boilerplate(docs.limit(0)).collect() == []


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "Menu\nown", "s", "k", "h", "b", "o") for i in range(4)], "doc_id long, text string, source string, kept_lines string, __host string, boilerplate string, OF_HOST string")
    out = without_boilerplate(docs)
    assert out.columns == docs.columns
    assert [tuple(r)[1:] for r in out.collect()] == [("", "s", "k", "h", "b", "o")] * 4
