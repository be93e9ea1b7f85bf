"""Queries of rule labels over typed-in acts and the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import cases
from plumbline.functions import lexicon as lex
from plumbline.operators import labels as lb
from plumbline.queries import neighbours, query, table, words_sql
from plumbline.queries_text import pieces_sql

ACTS = [
    ("d1", "Согласно статье 12 закона срок хранения первичных учётных документов составляет 5 лет. В соответствии с п. 3 штраф за нарушение равен 1000 рублей и пени 0,5 процента."),
    ("d2", "Глава 4. Плата взимается в размере 20 руб. за каждый лист бумаги формата А4, но выдача копий граждан занимает 30 дней."),
]
ANSWERS = [
    ("a1", "d1", "Статья 12 устанавливает срок хранения первичных учётных документов, он составляет 7 лет."),
    ("a2", "d1", "По статье 15 штраф за нарушение равен 1000 рублей."), ("a3", "d1", "Штраф примерно 900 рублей."),
    ("a4", "d2", "Плата взимается в размере 30 руб. за каждый лист бумаги формата А4."), ("a5", "d2", "Выдача копий граждан занимает 5-10 дней."),
    ("a6", "d2", "Ничего числового здесь нет."), ("a7", "d2", "Выдача копий граждан занимает 30 дней, глава 4."),
]
NUMBER = lb.NUMBER
RE2_PIECE = lb.PIECE.replace(r"(?<!\w)", "").replace("'", "''")
UNCLEAR = " OR ".join(f"contains(around, '{h}')" for h in lex.HEDGES)


def near_sql(text: str, start: str, stop: str) -> str:
    left, right = f"substr({text}, (greatest(0, {start} - 90) + 1)::INT, least({start}, 90)::INT)", f"substr({text}, ({stop} + 1)::INT, 90)"
    return f"list_distinct(list_filter(regexp_extract_all(lower({left} || ' ' || {right}), '[а-яёa-z]{{3,}}'), lambda w: w NOT IN ({words_sql(lex.ATOM_STOP_WORDS)})))"


def atoms_sql(name: str, source: str) -> str:
    """CTE of the atoms of source(id, text)."""
    return f"""{pieces_sql(name + '0', source, '(?i)' + RE2_PIECE)}, {name}1 AS (SELECT p.id, p, sum(length(p)) OVER (PARTITION BY p.id ORDER BY i) AS stop, s.text AS whole FROM {name}0 p JOIN {source} s USING (id)),
    {name}2 AS (SELECT id, p, whole, stop - length(p) AS start, stop, regexp_matches(p, '^[0-9]') AS num FROM {name}1 WHERE regexp_matches(p, '[0-9]')),
    {name}3 AS (SELECT *, CASE WHEN num THEN regexp_extract(p, '^{NUMBER}') ELSE regexp_extract(p, '\\d+(?:[.\\-]\\d+)*$') END AS digits FROM {name}2 WHERE NOT num OR start = 0 OR NOT regexp_matches(substr(whole, start::INT, 1), '[\\p{{L}}\\p{{N}}_]')),
    {name} AS (SELECT id, start, stop, CASE WHEN num THEN 'number' ELSE 'citation' END AS kind, p AS text, trim(replace(replace(digits, ' ', ''), ',', '.'), '.') AS value, CASE WHEN num THEN trim(substr(p, length(digits) + 1)) ELSE '' END AS unit,
        num AND regexp_matches(substr(whole, stop::INT + 1, 3), '^\\s*[-—–]\\s*\\d') AS is_range, {near_sql('whole', 'start', 'stop')} AS near, lower(substr(whole, (greatest(0, start - 90) + 1)::INT, (least(length(whole), stop + 90) - greatest(0, start - 90))::INT)) AS around FROM {name}3)"""


CASES_SQL = f"{cases.values_sql('acts', 'id, text', ACTS)}, {cases.values_sql('ans', 'id, doc_id, text', ANSWERS)}"
RULES = f"""{atoms_sql('sa', 'ans')}, {atoms_sql('aa', 'acts')}, {pieces_sql('an0', 'acts', NUMBER + '|[^0-9]+|[\\s\\S]')}, an1 AS (SELECT p.id, p, sum(length(p)) OVER (PARTITION BY p.id ORDER BY i) AS stop, a.text AS whole FROM an0 p JOIN acts a USING (id)),
    an AS (SELECT id, trim(replace(p, ',', '.'), '.') AS value, {near_sql('whole', 'stop - length(p)', 'stop')} AS near FROM an1 WHERE regexp_matches(p, '^[0-9]') AND (stop = length(p) OR NOT regexp_matches(substr(whole, (stop - length(p))::INT, 1), '[\\p{{L}}\\p{{N}}_]'))),
    known AS (SELECT DISTINCT id, value, 'number' AS kind FROM an UNION SELECT DISTINCT id, value, 'citation' FROM aa WHERE kind = 'citation'),
    cj AS (SELECT s.id, s.start, s.value, n.value AS other, len(list_intersect(s.near, n.near)) AS met, len(s.near) + len(n.near) - len(list_intersect(s.near, n.near)) AS all_ FROM sa s JOIN ans USING (id) JOIN an n ON n.id = ans.doc_id),
    cf AS (SELECT id, start, min(other) FILTER (other <> value) AS conflict, arg_max(other, (met / all_, other)) AS best, any_value(value) AS value FROM cj WHERE met > 0 AND met / all_ >= 0.6 GROUP BY id, start),
    ruled AS (SELECT s.*, ans.doc_id, conflict, best, CASE WHEN is_range OR {UNCLEAR} THEN 'unclear' WHEN k.id IS NULL THEN CASE WHEN s.kind = 'citation' THEN 'b' ELSE 'a' END WHEN conflict IS NOT NULL THEN 'c' END AS rule,
        CASE WHEN is_range OR {UNCLEAR} THEN 'unclear' WHEN k.id IS NULL THEN CASE WHEN s.kind = 'citation' THEN 'b' ELSE 'a' END WHEN best <> s.value THEN 'c' END AS strict FROM sa s JOIN ans USING (id) LEFT JOIN known k ON k.id = ans.doc_id AND k.value = s.value AND k.kind = s.kind LEFT JOIN cf ON cf.id = s.id AND cf.start = s.start)"""


def _tables(spark):
    return spark.createDataFrame(ANSWERS, "answer_id string, doc_id string, answer string"), spark.createDataFrame(ACTS, "doc_id string, text string")


@query(f"WITH {CASES_SQL}, {atoms_sql('sa', 'ans')} SELECT id AS answer_id, start::BIGINT AS start, stop::BIGINT AS \"end\", kind, text, value, unit, is_range FROM sa")
def answer_atoms(spark, sf):
    out = lb.atoms(_tables(spark)[0], "answer_id", "answer")
    return out.select("answer_id", F.col("start").cast("long"), F.col("end").cast("long"), "kind", "text", "value", "unit", "is_range")


@query(f"WITH docs AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {atoms_sql('sa', 'docs')} SELECT id, kind, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS n_values, sum(len(near))::BIGINT AS n_near FROM sa GROUP BY id, kind")
def document_atoms(spark, sf):
    out = lb.atoms(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    return out.groupBy(F.col("doc_id").alias("id"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"), F.sum(F.size("near")).cast("long").alias("n_near"))


@query(f"WITH {CASES_SQL}, {RULES} SELECT id AS answer_id, start::BIGINT AS start, rule, CASE WHEN rule = 'c' THEN conflict END AS conflict FROM ruled")
def rule_labels(spark, sf):
    out = lb.labelled(*_tables(spark))
    return out.select("answer_id", F.col("start").cast("long"), "rule", F.when(F.col("rule") == "c", F.col("conflict")).alias("conflict"))


@query(f"WITH {CASES_SQL}, {RULES} SELECT id AS answer_id, start::BIGINT AS start, strict AS rule FROM ruled")
def rule_labels_by_best_window(spark, sf):
    return lb.labelled(*_tables(spark), mode="best_window").select("answer_id", F.col("start").cast("long"), "rule")


@query(f"WITH {CASES_SQL}, {RULES} SELECT id AS answer_id, count(*)::BIGINT AS n_atoms, count(*) FILTER (rule = 'unclear')::BIGINT AS n_unclear, count(*) FILTER (rule IN ('a', 'b', 'c'))::BIGINT AS n_spans, coalesce(list_sort(list(DISTINCT rule) FILTER (rule IN ('a', 'b', 'c'))), []) AS rules, CASE WHEN count(*) FILTER (rule IN ('a', 'b', 'c')) > 0 THEN 'erroneous' WHEN count(*) FILTER (rule = 'unclear') > 0 THEN 'unclear' ELSE 'clean' END AS category FROM ruled GROUP BY id")
def answer_categories(spark, sf):
    return lb.answer_categories(lb.labelled(*_tables(spark)))


@query(f"WITH ans AS (SELECT d.doc_id AS id, d.doc_id - 1 AS doc_id, coalesce(d.text, '') AS text FROM documents d JOIN documents e ON e.doc_id = d.doc_id - 1), acts AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {RULES} SELECT rule, count(*)::BIGINT AS n FROM ruled GROUP BY rule")
def document_rules(spark, sf):
    """Every document judged by the one before it."""
    rows = neighbours(spark, sf)
    answers = rows.select((F.col("pair_id") + 1).alias("answer_id"), F.col("pair_id").alias("doc_id"), F.coalesce("answer", F.lit("")).alias("answer"))
    acts = rows.select(F.col("pair_id").alias("doc_id"), F.coalesce("context", F.lit("")).alias("text"))
    return lb.labelled(answers, acts).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
