"""Queries of text functions: normal forms, style tokens and sentences, scaled features, predicates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import cases
from plumbline.cases import TEXTS_SQL
from plumbline.functions import lexicon as lex
from plumbline.functions import normalize as nm
from plumbline.functions import scales, style
from plumbline.functions import text as tx
from plumbline.operators import features as ft
from plumbline.queries import BLANKS, PAIRS, edge_sql, number_sql, pairs, query, table, tokens_sql, words_sql

NOT_WORD = r"[^\p{L}\p{N}_]"
WORD_SQL = nm.WORD.replace("'", "''")


def pieces_sql(name: str, table_: str, pattern: str) -> str:
    """CTE of (id, i, p): all matches of a pattern, from 0."""
    return f"{name} AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS ps FROM {table_}))"


def part_sql(x: str) -> str:
    return f"CASE lower({x}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lex.NUMBER_PARTS.items()) + " END"


def digits_sql(source: str = "cases", p: str = "") -> str:
    """CTEs that end in {p}digits(id, text): runs of number words as digits, by windows over the pieces of a text."""
    return f"""{pieces_sql(p + 'dp', source, nm.PIECE.replace("'", "''"))},
    {p}dw AS (SELECT *, {part_sql('p')} AS v, regexp_matches(p, '^[{nm.LETTERS}]') AS w FROM {p}dp),
    {p}dr AS (SELECT *, sum(CASE WHEN w AND v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run FROM {p}dw),
    {p}ds AS (SELECT *, coalesce(sum(CASE WHEN v >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM {p}dr WHERE v IS NOT NULL),
    {p}dg AS (SELECT id, run, seg, bool_or(v >= 1000) AS big, coalesce(sum(v) FILTER (v < 1000), 0) AS small, min(i) AS a, max(i) AS b FROM {p}ds GROUP BY ALL),
    {p}dv AS (SELECT id, run, sum(CASE WHEN big THEN greatest(small, 1) * 1000 ELSE small END)::BIGINT AS value, min(a) AS a, max(b) AS b FROM {p}dg GROUP BY ALL),
    {p}dt AS (SELECT r.id, string_agg(CASE WHEN a IS NULL OR i < a OR i > b THEN p WHEN i = a THEN value::VARCHAR ELSE '' END, '' ORDER BY i) AS text FROM {p}dr r LEFT JOIN {p}dv USING (id, run) GROUP BY r.id),
    {p}digits AS (SELECT c.id, coalesce(d.text, '') AS text FROM {source} c LEFT JOIN {p}dt d USING (id))"""


def dates_sql(x: str) -> str:
    for i, month in enumerate(lex.MONTHS, 1):
        for day, zero in (("[0-9]{2}", ""), ("[0-9]", "0")):
            x = rf"regexp_replace({x}, '(?i)(^|{NOT_WORD})({day})\s+{month}\s+([0-9]{{4}})(\s*(г(ода)?\.?)?)($|[^А-Яа-яЁё])', '\1{zero}\2.{i:02d}.\3\7', 'g')"
    x = rf"regexp_replace({x}, '(^|{NOT_WORD})([0-9])[.]([0-9]{{1,2}})[.]([0-9]{{2,4}})($|{NOT_WORD})', '\10\2.\3.\4\5', 'g')"
    x = rf"regexp_replace({x}, '(^|{NOT_WORD})([0-9]{{2}})[.]([0-9])[.]([0-9]{{2,4}})($|{NOT_WORD})', '\1\2.0\3.\4\5', 'g')"
    return rf"regexp_replace({x}, '(^|{NOT_WORD})([0-9]{{2}}[.][0-9]{{2}})[.]([0-9]{{2}})($|{NOT_WORD})', '\1\2.20\3\4', 'g')"


def units_sql(x: str) -> str:
    for form in sorted(lex.UNITS, key=len, reverse=True):
        plain = form.replace(".", "[.]")
        if not form[0].isalpha():
            x = f"replace({x}, '{form}', '{lex.UNITS[form]}')"
        else:
            after = r"[\p{L}\p{N}_]" if form[-1] == "." else f"$|{NOT_WORD}"
            x = rf"regexp_replace({x}, '(?i)(^|{NOT_WORD}){plain}({after})', '\1{lex.UNITS[form]}\2', 'g')"
    return x


def stem_sql(x: str) -> str:
    low = f"translate(lower({x}), 'ё', 'е')"
    return f"CASE WHEN length({low}) <= 4 THEN {low} " + " ".join(f"WHEN ends_with({low}, '{e}') AND length({low}) >= {len(e) + 3} THEN left({low}, length({low}) - {len(e)})" for e in lex.ENDINGS) + f" ELSE {low} END"


def matched_sql(source: str, p: str = "") -> str:
    """CTEs that end in {p}matched(id, text): the form for matching of source(id, text) whose numbers are digits."""
    return f"""{p}normal AS (SELECT id, {units_sql(dates_sql('text'))} AS text FROM {source}), {pieces_sql(p + 'mp', p + 'normal', f'[{nm.LETTERS}]+|{nm.NUMERAL}')},
    {p}matched AS (SELECT n.id, coalesce(string_agg(CASE WHEN regexp_matches(p, '^[{nm.LETTERS}]') THEN {stem_sql('p')} ELSE p END, ' ' ORDER BY i), '') AS text FROM {p}normal n LEFT JOIN {p}mp USING (id) GROUP BY n.id)"""


def stems_sql(x: str) -> str:
    """The stems of a text's words as a list."""
    return f"list_transform(regexp_extract_all({x}, '{WORD_SQL}'), lambda w: {stem_sql('w')})"


# ---- normal forms


@query(f"WITH {TEXTS_SQL} SELECT id, regexp_matches(text, '[0-9]') AS found FROM (SELECT * FROM cases UNION ALL SELECT doc_id + 100, coalesce(text, '') FROM documents)")
def holds_numbers(spark, sf):
    docs = table(spark, sf, "documents").select((F.col("doc_id") + 100).alias("id"), "text")
    return cases.texts(spark).unionByName(docs).select("id", nm.has_number(F.col("text")).alias("found"))


WORD_LISTS = [(1, ["двадцать", "пять"]), (2, ["Две", "тысячи", "триста"]), (3, ["тысяча"]), (4, ["пять", "лет"]), (5, []), (6, ["сто", "одного"]), (7, ["тысяча", "тысяч", "двух"])]


@query(f"""WITH {cases.values_sql('lists', 'id, ws', [(i, w or ['']) for i, w in WORD_LISTS])}, u AS (SELECT id, unnest(list_filter(ws, lambda w: w <> '')) AS w, generate_subscripts(list_filter(ws, lambda w: w <> ''), 1) AS i FROM lists),
    v AS (SELECT *, {part_sql('w')} AS v FROM u), s AS (SELECT *, coalesce(sum(CASE WHEN v >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM v),
    g AS (SELECT id, seg, bool_or(v IS NULL) AS bad, bool_or(v >= 1000) AS big, coalesce(sum(v) FILTER (v < 1000), 0) AS small FROM s GROUP BY ALL)
    SELECT l.id, CASE WHEN NOT bool_or(bad) THEN sum(CASE WHEN big THEN greatest(small, 1) * 1000 ELSE small END) END::BIGINT AS value FROM lists l LEFT JOIN g USING (id) GROUP BY l.id""")
def words_to_number(spark, sf):
    return spark.createDataFrame(WORD_LISTS, "id int, ws array<string>").select("id", nm.number_of_words(F.col("ws")).alias("value"))


@query(f"WITH {TEXTS_SQL}, {digits_sql()} SELECT id, text FROM digits")
def numbers_to_digits(spark, sf):
    return cases.texts(spark).select("id", nm.digits_for_words(F.col("text")).alias("text"))


@query(f"WITH {TEXTS_SQL} SELECT id, {dates_sql('text')} AS text FROM cases")
def normalized_dates(spark, sf):
    return cases.texts(spark).select("id", nm.normalized_dates(F.col("text")).alias("text"))


@query(f"WITH {TEXTS_SQL} SELECT id, {units_sql('text')} AS text FROM cases")
def normalized_units(spark, sf):
    return cases.texts(spark).select("id", nm.normalized_units(F.col("text")).alias("text"))


@query(f"WITH {TEXTS_SQL}, {digits_sql()} SELECT id, {units_sql(dates_sql('text'))} AS text FROM digits")
def normalized_numbers(spark, sf):
    return cases.texts(spark).select("id", nm.normalized_numbers(F.col("text")).alias("text"))


@query(f"WITH {TEXTS_SQL}, a AS (SELECT id, text FROM cases UNION ALL SELECT doc_id + 100, coalesce(text, '') FROM documents), {pieces_sql('w', 'a', WORD_SQL)} SELECT DISTINCT p AS word, {stem_sql('p')} AS stem FROM w")
def stemmed_words(spark, sf):
    rows = cases.texts(spark).select("text").unionByName(table(spark, sf, "documents").select("text"))
    words = rows.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({nm.WORD})"), F.lit(1))).alias("word")).distinct()
    return words.select("word", nm.stemmed(F.col("word")).alias("stem"))


@query(f"WITH {TEXTS_SQL}, {pieces_sql('w', 'cases', WORD_SQL)} SELECT c.id, coalesce(string_agg({stem_sql('p')}, ' ' ORDER BY i), '') AS stems FROM cases c LEFT JOIN w USING (id) GROUP BY c.id")
def text_stems(spark, sf):
    return cases.texts(spark).select("id", F.array_join(nm.stems_of(F.col("text")), " ").alias("stems"))


@query(f"WITH {TEXTS_SQL}, {digits_sql()}, {matched_sql('digits')} SELECT id, text FROM matched")
def normalized_for_match(spark, sf):
    return cases.texts(spark).select("id", nm.for_match(F.col("text")).alias("text"))


@query(f"WITH {TEXTS_SQL}, t0 AS (SELECT id, regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS ts FROM cases) SELECT id, array_to_string(list_filter(ts, lambda t: length(t) > 1 AND t NOT IN ({words_sql(lex.SEARCH_STOP_WORDS)})), ' ') AS terms FROM t0")
def search_terms(spark, sf):
    return cases.texts(spark).select("id", F.array_join(nm.without_search_stop_words(tx.search_terms(F.col("text"))), " ").alias("terms"))


@query(f"WITH {TEXTS_SQL}, {tokens_sql('tok', '(SELECT id AS pair_id, text AS context FROM cases)', 'pair_id', 'context')} SELECT pair_id AS id, {number_sql('text')} AS value, count(*)::BIGINT AS n FROM tok WHERE {number_sql('text')} IS NOT NULL GROUP BY ALL")
def number_values(spark, sf):
    """Numbers that single words stand for, digits or words."""
    toks = tx.tokens(cases.texts(spark), ["id"], "text")
    return toks.select("id", tx.number_value(tx.edge_word(F.col("text"))).alias("value")).where("value is not null").groupBy("id", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TEXTS_SQL}, {tokens_sql('tok', '(SELECT id AS pair_id, text AS context FROM cases)', 'pair_id', 'context')} SELECT pair_id AS id, list_sort(list(DISTINCT {number_sql('text')})) AS numbers FROM tok WHERE {number_sql('text')} IS NOT NULL GROUP BY 1")
def numbers_in(spark, sf):
    toks = tx.tokens(cases.texts(spark), ["id"], "text").withColumn("value", tx.number_value(tx.edge_word(F.col("text"))))
    return toks.where("value is not null").groupBy("id").agg(F.sort_array(F.collect_set("value")).alias("numbers"))


# ---- style tokens and sentences

STYLE = style.PIECE.replace("'", "''")
SPLIT = r"string_split(regexp_replace({}, '([.!?…][ \t]+)([«\"(]?[A-ZА-ЯЁ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"
#: Sentence pieces; one whose last word is an abbreviation goes on in the next.
STYLE_SENTENCES = rf"""p0 AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM (SELECT id, {SPLIT.format('text')} AS ps FROM a)),
    p1 AS (SELECT *, lower(trim(regexp_extract(p, '([^\s«\"(]*)\s*$', 1), '.,!?…')) IN ({words_sql(lex.ABBREVIATIONS)}) AS goes_on FROM p0),
    p2 AS (SELECT *, i - coalesce(sum(goes_on::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx, sum(length(p)) OVER (PARTITION BY id ORDER BY i) AS stop FROM p1),
    sent AS (SELECT id, idx, string_agg(p, '' ORDER BY i) AS text, min(stop - length(p)) AS start, max(stop) AS stop FROM p2 GROUP BY ALL HAVING trim(string_agg(p, '' ORDER BY i), {BLANKS}) <> '')"""
STYLE_TEXTS = f"{TEXTS_SQL}, a AS (SELECT id, text FROM cases UNION ALL SELECT doc_id + 100, text FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL)".replace(" WHERE doc_id % 10 = 0 AND", " WHERE")


def _style_rows(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select((F.col("doc_id") + 100).alias("id"), "text")
    return cases.texts(spark).unionByName(docs)


@query(f"WITH {STYLE_TEXTS}, {pieces_sql('w', 'a', STYLE)} SELECT id, count(*)::BIGINT AS n_tokens, count(*) FILTER (regexp_matches(p, '^[A-Za-zА-Яа-яЁё0-9]'))::BIGINT AS n_words, sum(length(p))::BIGINT AS n_chars FROM w GROUP BY id")
def style_tokens(spark, sf):
    toks = style.tokens(_style_rows(spark, sf), ["id"], "text")
    return toks.groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("kind") == "word").alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH {TEXTS_SQL}, {pieces_sql('w', 'cases', STYLE)}, s AS (SELECT *, sum(length(p)) OVER (PARTITION BY id ORDER BY i) AS stop FROM w)
    SELECT id, i::BIGINT AS idx, p AS text, (stop - length(p))::BIGINT AS start, stop::BIGINT AS "end" FROM s WHERE regexp_matches(p, '^[A-Za-zА-Яа-яЁё0-9]')""")
def style_words(spark, sf):
    toks = style.tokens(cases.texts(spark), ["id"], "text").where("kind = 'word'")
    return toks.select("id", F.col("idx").cast("long"), "text", F.col("start").cast("long"), F.col("end").cast("long"))


@query(f'WITH {STYLE_TEXTS}, {STYLE_SENTENCES} SELECT id, start::BIGINT AS start, stop::BIGINT AS "end" FROM sent')
def style_sentences(spark, sf):
    return style.sentences(_style_rows(spark, sf), ["id"], "text").select("id", F.col("start").cast("long"), F.col("end").cast("long"))


@query(f"""WITH {TEXTS_SQL}, a AS (SELECT * FROM cases), {STYLE_SENTENCES}, {pieces_sql('w', 'cases', STYLE)}, t AS (SELECT *, sum(length(p)) OVER (PARTITION BY id ORDER BY i) AS e FROM w)
    SELECT id, idx::BIGINT AS sentence, min(i)::BIGINT AS first, max(i)::BIGINT + 1 AS stop FROM sent JOIN t USING (id) WHERE e > start AND e - length(p) < sent.stop GROUP BY id, idx""")
def sentence_tokens(spark, sf):
    out = style.sentence_tokens(cases.texts(spark), ["id"], "text")
    return out.select("id", F.col("sentence").cast("long"), F.col("first").cast("long"), F.col("stop").cast("long"))


@query(f"WITH {TEXTS_SQL}, a AS (SELECT id, text FROM cases UNION ALL SELECT page_id + 100, url FROM pages) SELECT id, list_filter(regexp_extract_all(text, '[А-Яа-яЁё]{{6,}}'), lambda w: lower(w) NOT IN ({words_sql(lex.TITLE_STOP_WORDS)}))[1:6] AS words FROM a WHERE text IS NOT NULL")
def title_words(spark, sf):
    rows = cases.texts(spark).unionByName(table(spark, sf, "pages").select((F.col("page_id") + 100).alias("id"), F.col("url").alias("text"))).where("text is not null")
    return rows.select("id", nm.title_words(F.col("text")).alias("words"))


# ---- contexts, limits, values

CHUNKS = [(1, ["one", "  ", "two two", ""]), (2, ["x"]), (3, []), (4, ["\n", " lead", "tail "])]


@query(f"""WITH {cases.values_sql('lists', 'id, cs', [(i, c or ['']) for i, c in CHUNKS])}, k AS (SELECT id, list_filter(cs, lambda c: trim(c, {BLANKS}) <> '') AS cs FROM lists),
    u AS (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM k), p AS (SELECT *, sum(length(c) + 1) OVER (PARTITION BY id ORDER BY i) - length(c) - 1 AS place FROM u)
    SELECT k.id, array_to_string(k.cs, chr(10)) AS text, k.cs AS chunks, coalesce(list(place::INT ORDER BY i) FILTER (place IS NOT NULL), []) AS positions FROM k LEFT JOIN p USING (id) GROUP BY ALL""")
def context_chunks(spark, sf):
    return spark.createDataFrame(CHUNKS, "id int, cs array<string>").select("id", nm.context_of_list(F.col("cs")).alias("c")).select("id", "c.*")


@query("SELECT doc_id, coalesce(length(text), 0) <= 500 AS fits, CASE WHEN length(text) > 500 THEN 'text: ' || length(text) || ' characters, 500 at most' END AS problem FROM documents")
def text_limits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nm.within_limit(F.col("text"), 500).alias("fits"), nm.length_problem(F.col("text"), "text", 500).alias("problem"))


_VALUES = [(1, " 1 200,50 "), (2, "7."), (3, ".5,"), (4, "12-3"), (5, "10 000")]


@query(f"WITH {cases.values_sql('v', 'id, text', _VALUES)} SELECT id, trim(replace(replace(replace(text, ' ', ''), chr(160), ''), ',', '.'), '.') AS value FROM v")
def plain_values(spark, sf):
    return spark.createDataFrame(_VALUES, "id int, text string").select("id", nm.plain_value(F.col("text")).alias("value"))


@query(f"""WITH {TEXTS_SQL}, {pieces_sql('w', 'cases', '[0-9]+|[^0-9]+')}, s AS (SELECT *, sum(length(p)) OVER (PARTITION BY id ORDER BY i) AS stop FROM w),
    n AS (SELECT id, i, substr(text, greatest(0, stop - length(p) - 10)::INT + 1, (least(length(text), stop + 10) - greatest(0, stop - length(p) - 10))::INT) AS near FROM s JOIN cases USING (id) WHERE regexp_matches(p, '^[0-9]'))
    SELECT id, i::BIGINT AS idx, {' OR '.join(f"contains(lower(near), '{h}')" for h in lex.HEDGES)} AS unclear FROM n""")
def unclear_numbers(spark, sf):
    rows = cases.texts(spark).withColumn("whole", F.col("text"))
    found = tx.placed(rows, ["id", "whole"], F.regexp_extract_all(F.col("text"), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), F.lit(0)).where(F.col("text").rlike("^[0-9]"))
    return found.select("id", F.col("idx").cast("long"), nm.unclear_near(F.col("whole"), F.col("start"), F.col("end"), 10).alias("unclear"))


_LAYERS = ["first", "middle", "last", "", " -4 ", "3", "99", "-99", "what", "-1"]


@query("WITH v(id, name, layer) AS (VALUES " + ", ".join(f"({i}, '{n}', {r})" for i, (n, r) in enumerate(zip(_LAYERS, [0, 5, 11, 11, 8, 3, 11, 0, 11, 11], strict=True))) + ") SELECT id, name, layer FROM v")
def layer_indices(spark, sf):
    return spark.createDataFrame(list(enumerate(_LAYERS)), "id int, name string").select("id", "name", nm.layer_index(F.col("name"), 12).alias("layer"))


@query("SELECT vec_id, CASE WHEN embedding[1] > 0 THEN ln(embedding[1]::DOUBLE) END AS value FROM embeddings")
def finite_values(spark, sf):
    """Logarithms as JSON can hold them."""
    x = F.col("embedding")[0].cast("double")
    return table(spark, sf, "embeddings").select("vec_id", nm.finite(F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.log(x))).alias("value"))


# ---- scaled features

MASSES = f"""WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')}, n AS (SELECT pair_id, len(regexp_extract_all(context, '[\\p{{L}}\\p{{N}}]+')) AS c FROM pairs),
    t AS (SELECT pair_id, idx, c, length(text) / 12.0 AS seen, CASE WHEN c + idx + 1 <= 0 OR c <= 0 THEN 0.0 ELSE least(1.0, c / (c + idx + 1)::DOUBLE) END AS expected FROM tok JOIN n USING (pair_id))"""


@query(MASSES + """ SELECT pair_id, idx::BIGINT AS idx, round(expected, 9) AS expected, round(CASE WHEN expected <= 1e-9 THEN 0.0 ELSE seen / expected END, 9) AS relative, round(greatest(-1.0, least(1.0, seen - expected)), 9) AS lift,
    round(seen - expected / 2, 9) AS contrast, round(CASE WHEN c <= 1 THEN 0.0 ELSE least(1.0, idx / (c - 1)::DOUBLE) END, 9) AS distance, round(seen * exp(-idx / 20.0), 9) AS decayed FROM t""")
def mass_features(spark, sf):
    """A token's length in place of an attention mass, its place in the answer after all context."""
    rows = pairs(spark, sf).withColumn("c", F.size(F.regexp_extract_all("context", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))
    toks = tx.tokens(rows, ["pair_id", "c"], "answer").withColumn("seen", F.length("text") / 12)
    toks = toks.withColumn("expected", scales.expected_mass(F.col("c"), F.col("c") + F.col("idx")))
    seen, expected, idx = F.col("seen"), F.col("expected"), F.col("idx")
    out = {"expected": expected, "relative": scales.relative_mass(seen, expected), "lift": scales.mass_lift(seen, expected), "contrast": scales.contrast(seen, expected / 2), "distance": scales.relative_distance(idx, F.col("c")), "decayed": scales.decayed(seen, idx, 20)}
    return toks.select("pair_id", idx.cast("long").alias("idx"), *(F.round(v, 9).alias(k) for k, v in out.items()))


@query("""WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rank, count(value) OVER (PARTITION BY event_type) AS n, max(value) OVER (PARTITION BY event_type) AS top FROM events WHERE value IS NOT NULL),
    q AS (SELECT event_type, max(value) FILTER (rank = round_even(0.9 * (n - 1), 0)) AS high FROM r GROUP BY 1) SELECT event_id, round(CASE WHEN high <= 1e-12 THEN 0 ELSE least(1, greatest(0, value / high)) END, 9)::DOUBLE AS robust, round(CASE WHEN top <= 1e-12 THEN 0 ELSE least(1, greatest(0, value / top)) END, 9)::DOUBLE AS plain FROM r JOIN q USING (event_type)""")
def robust_scaling(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").select("event_type", "event_id", "value")
    out = scales.scaled(scales.scaled(rows, "event_type", "value", "robust", 0.9), "event_type", "value", "plain")
    return out.select("event_id", F.round("robust", 9).alias("robust"), F.round("plain", 9).alias("plain"))


@query(f"WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')}, e AS (SELECT pair_id, count(*)::BIGINT AS n FROM tok GROUP BY 1) SELECT pair_id, n AS entropy, n AS mass, n AS mass_norm, n AS max_sim, n AS density FROM e")
def feature_lists(spark, sf):
    """The five working features of an answer as lists in token order; here their lengths."""
    from plumbline.operators.shaping import feature_lists as lists

    out = lists(ft.token_features(pairs(spark, sf)))
    return out.select("pair_id", *(F.size(n).cast("long").alias(n) for n in lex.WEIGHTS))
