"""Queries of facts, spans and verdict rules over typed-in pairs and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import cases
from plumbline.cases import PAIRS_SQL
from plumbline.functions import lexicon as lex
from plumbline.operators import coverage as cv
from plumbline.operators import shaping as sh
from plumbline.plans import verify as vf
from plumbline.queries import _FEATURES, BLANKS, SENTENCES, neighbours, pairs, query, table, words_sql
from plumbline.queries_text import digits_sql, matched_sql, pieces_sql, stems_sql

VALUE_SQL = cv.PIECE.replace("'", "''")
KIND_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(p, '(?i){v}') THEN '{k}'" for k, v in lex.VALUE_PATTERNS.items()) + " END"


def sentences_sql(name: str, source: str, column: str) -> str:
    """CTE of (pair_id, idx, text, start, stop): the sentences of a text column that aren't blank."""
    return f"""{name} AS (SELECT pair_id, i AS idx, text, stop - length(text) AS start, stop FROM (SELECT *, sum(length(text)) OVER (PARTITION BY pair_id ORDER BY i) AS stop FROM
        (SELECT pair_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS i FROM (SELECT pair_id, {SENTENCES.format(column)} AS ss FROM {source}))) WHERE trim(text, {BLANKS}) <> '')"""


def values_sql(name: str, source: str) -> str:
    """CTE of (id, i, at_, value, kind): the values of source(id, text)."""
    return f"""{pieces_sql(name + '0', source, '(?i)' + VALUE_SQL)}, {name} AS (SELECT id, i, at_, trim(p, {BLANKS}) AS value, kind FROM
        (SELECT *, sum(length(p)) OVER (PARTITION BY id ORDER BY i) - length(p) AS at_, CASE WHEN regexp_matches(p, '[0-9]') OR length(p) > 3 THEN {KIND_SQL} END AS kind FROM {name}0) WHERE kind IS NOT NULL)"""


PLAIN = words_sql(cv.PLAIN_KINDS)
#: The first 60 facts of a pair; queries of whole documents leave it out.
FIRST = " QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY idx) <= 60"
FACTS = f"""{sentences_sql('cs', 'cases', 'context')}, fs AS (SELECT pair_id || '|' || idx AS id, * FROM cs WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 5), {values_sql('fv', 'fs')},
    fb AS (SELECT id, arg_min({{'at_': at_, 'value': value, 'kind': kind}}, (kind IN ({PLAIN}), i)) AS v FROM fv GROUP BY id),
    facts AS (SELECT id, pair_id, idx AS sentence, text, start, v.value AS value, start + v.at_ AS value_start, v.kind AS kind,
        array_to_string(list_filter(list_transform(regexp_extract_all(left(text, v.at_::INT), '[А-Яа-яЁёA-Za-z]+'), lambda w: lower(w)), lambda w: w NOT IN ({words_sql(lex.NO_SUBJECT)}) AND length(w) >= 3)[-4:], ' ') AS subject,
        list_min(list_filter([{', '.join(f"strpos(lower(text), '{c}')" for c in lex.CONDITIONS)}], lambda p: p > 0)) AS cond_at FROM fs JOIN fb USING (id){FIRST}),
    facts2 AS (SELECT *, coalesce(trim(string_split(substr(text, cond_at), ',')[1], ' ,.;:'), '') AS condition FROM facts)"""
COVERED = f"""{FACTS}, an AS (SELECT pair_id AS id, answer AS text FROM cases), {digits_sql('an', 'a')}, {matched_sql('adigits', 'a')}, vn AS (SELECT id, value AS text FROM facts), {digits_sql('vn', 'v')}, {matched_sql('vdigits', 'v')},
    {sentences_sql('said', 'cases', 'answer')}, pool AS (SELECT *, {stems_sql('text')} AS pool FROM said), fst AS (SELECT *, {stems_sql('text')} AS stems FROM facts2),
    ov AS (SELECT f.id, s.start, s.stop, s.text, s.idx, len(list_filter(f.stems, lambda x: list_contains(s.pool, x))) / len(f.stems)::DOUBLE AS overlap FROM fst f JOIN pool s USING (pair_id)),
    best AS (SELECT id, max(overlap) AS overlap, arg_max({{'start': start, 'stop': stop, 'text': text}}, (overlap, -idx)) AS b FROM ov GROUP BY id),
    bt AS (SELECT id, b.text AS text FROM best), {values_sql('bv', 'bt')}, bn AS (SELECT id || '#' || i AS id, value AS text FROM bv), {digits_sql('bn', 'b')}, {matched_sql('bdigits', 'b')},
    oth AS (SELECT f.id, count(*) FILTER (o.kind = f.kind) AS n_same, bool_or(m.text <> v.text) FILTER (o.kind = f.kind) AS same_other, bool_or(m.text <> v.text) AS any_other FROM facts f JOIN bv o USING (id) JOIN bmatched m ON m.id = o.id || '#' || o.i JOIN vmatched v ON v.id = f.id GROUP BY f.id),
    j AS (SELECT f.*, c.answer, coalesce(best.overlap, 0) AS overlap, best.b AS b, v.text AS nv, string_split(a.text, ' ') AS ws, a.text AS normal, {stems_sql('f.subject')} AS os, {stems_sql('f.condition')} AS oc, CASE WHEN n_same > 0 THEN same_other ELSE any_other END AS other
        FROM facts2 f JOIN cases c USING (pair_id) JOIN amatched a ON a.id = f.pair_id JOIN vmatched v ON v.id = f.id LEFT JOIN best ON best.id = f.id LEFT JOIN oth ON oth.id = f.id WHERE c.answer <> ''),
    k AS (SELECT *, CASE WHEN len(os) > 0 THEN len(list_filter(os, lambda x: list_contains(ws, x))) / len(os)::DOUBLE ELSE 0 END AS own, CASE WHEN len(oc) > 0 THEN len(list_filter(oc, lambda x: list_contains(ws, x))) / len(oc)::DOUBLE ELSE 0 END AS held FROM j),
    covered AS (SELECT *, CASE WHEN nv <> '' AND contains(normal, nv) THEN CASE WHEN condition <> '' AND held < 0.5 THEN 'partial' ELSE 'mentioned' END
        WHEN own >= 1 AND overlap >= 0.55 THEN CASE WHEN coalesce(other, false) THEN 'distorted' ELSE 'omitted' END WHEN own >= 0.8 AND overlap >= 0.55 THEN 'distorted' ELSE 'irrelevant' END AS status,
        list_transform(list_filter(list_filter(regexp_extract_all(lower(subject), '[А-Яа-яЁёA-Za-z]+'), lambda w: length(w) > 2), lambda w: contains(lower(answer), w)), lambda w: {{'a': strpos(lower(answer), w) - 1, 'b': strpos(lower(answer), w) - 1 + length(w)}}) AS sp FROM k)"""


@query(f"WITH {PAIRS_SQL}, {FACTS} SELECT pair_id, sentence::BIGINT AS sentence, value, value_start::BIGINT AS value_start, kind, subject, condition FROM facts2")
def context_facts(spark, sf):
    rows = cv.facts(cases.pairs(spark))
    return rows.select("pair_id", F.col("sentence").cast("long"), "value", F.col("value_start").cast("long"), "kind", "subject", "condition")


@query(f"WITH docs AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {values_sql('v', 'docs')} SELECT id, kind, count(*)::BIGINT AS n, min(at_)::BIGINT AS first, any_value(value ORDER BY i) AS value FROM v GROUP BY id, kind".replace("any_value(value ORDER BY i)", "arg_min(value, i)"))
def value_kinds(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(cv.values(F.col("text"))).alias("v"))
    return rows.groupBy("id", F.col("v.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("v.at").cast("long").alias("first"), F.min_by("v.text", "v.at").alias("value"))


@query(f"""WITH {PAIRS_SQL}, {COVERED} SELECT pair_id, sentence::BIGINT AS sentence, kind, round(overlap, 4)::DOUBLE AS overlap, status,
    CASE WHEN status = 'irrelevant' OR (status = 'mentioned' AND len(os) = 0) THEN -1 WHEN overlap > 0 THEN b.start ELSE 0 END::BIGINT AS answer_start, CASE WHEN status = 'irrelevant' OR (status = 'mentioned' AND len(os) = 0) THEN -1 WHEN overlap > 0 THEN b.stop ELSE length(answer) END::BIGINT AS answer_end,
    CASE WHEN status = 'irrelevant' THEN -1 ELSE coalesce(list_min(list_transform(sp, lambda x: x.a)), -1) END::BIGINT AS subject_start, CASE WHEN status = 'irrelevant' THEN -1 ELSE coalesce(list_max(list_transform(sp, lambda x: x.b)), -1) END::BIGINT AS subject_end FROM covered""")
def fact_coverage(spark, sf):
    rows = cv.coverage(cases.pairs(spark))
    return rows.select("pair_id", F.col("sentence").cast("long"), "kind", "overlap", "status", *(F.col(c).cast("long") for c in ("answer_start", "answer_end", "subject_start", "subject_end")))


@query(f"WITH {PAIRS_SQL}, {COVERED} SELECT status, count(*)::BIGINT AS n FROM covered WHERE status IN ('omitted', 'partial') GROUP BY status")
def coverage_gaps(spark, sf):
    rows = cv.coverage(cases.pairs(spark))
    return cv.missing(rows).unionByName(cv.partial(rows)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH cases AS (SELECT d.doc_id::VARCHAR AS pair_id, coalesce(d.text, '') AS context, coalesce(e.text, '') AS answer FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 WHERE d.doc_id < 300), {COVERED} SELECT pair_id, status, count(*)::BIGINT AS n FROM covered GROUP BY ALL".replace(" WHERE d.doc_id < 300", "").replace(FIRST, ""))
def document_coverage(spark, sf):
    """Every document as the context of the next one, with all its facts."""
    rows = neighbours(spark, sf).select(F.col("pair_id").cast("string").alias("pair_id"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("answer", F.lit("")).alias("answer"))
    return cv.coverage(rows).groupBy("pair_id", "status").agg(F.count(F.lit(1)).alias("n"))


# ---- spans

CLAUSE_SQL, CLAUSE_PIECE_SQL = sh.CLAUSE.replace("'", "''"), sh.PIECE.replace("'", "''")
BARE = "' ' || chr(9) || chr(10) || chr(13) || ',;:()[]{}«»\"“”'"


def clauses_sql(source: str, spans: str, to: str = "clause") -> str:
    """CTEs that end in {to}: spans (pair_id, sid, start, stop, ks, ke, ...) of the answers of source with start and stop at clauses."""
    return f"""{sentences_sql('ase', source, 'answer')}, asid AS (SELECT pair_id || '#' || idx AS id, pair_id, start AS base, text FROM ase), {pieces_sql('bp', 'asid', '(?i)' + CLAUSE_PIECE_SQL)},
    bq AS (SELECT id, p, sum(length(p)) OVER (PARTITION BY id ORDER BY i) AS e FROM bp),
    br AS (SELECT a.pair_id, base + e - length(p) AS bs, base + e AS be FROM bq JOIN asid a USING (id) WHERE CASE WHEN p = '-' THEN regexp_full_match(substr(a.text, (e - 1)::INT, 1), '\\s') AND regexp_full_match(substr(a.text, e::INT + 1, 1), '\\s') AND e > 1 ELSE regexp_full_match(p, '(?i){CLAUSE_SQL}') END),
    ss AS (SELECT s.*, coalesce(a.start, s.start) AS s_start, greatest(coalesce(a.stop, s.stop), s.stop) AS s_end FROM {spans} s LEFT JOIN ase a ON a.pair_id = s.pair_id AND a.start <= s.start AND s.start < a.stop),
    lr AS (SELECT s.pair_id, s.sid, max(be) FILTER (be <= ks) AS l, min(bs) FILTER (bs >= ke) AS r FROM ss s JOIN br b ON b.pair_id = s.pair_id AND bs >= s_start AND be <= s_end GROUP BY ALL),
    lq AS (SELECT ss.*, answer, greatest(s_start, least(coalesce(l, s_start), ks)) AS lft, least(s_end, greatest(coalesce(r, s_end), ke)) AS rgt FROM ss LEFT JOIN lr USING (pair_id, sid) JOIN {source} USING (pair_id)),
    {to} AS (SELECT * EXCLUDE (start, stop, s_start, s_end, lft, rgt), CASE WHEN rgt <= lft OR trim(substr(answer, lft::INT + 1, (rgt - lft)::INT), {BARE}) = '' THEN s_start ELSE lft END AS start,
        CASE WHEN rgt <= lft OR trim(substr(answer, lft::INT + 1, (rgt - lft)::INT), {BARE}) = '' THEN s_end ELSE rgt END AS stop FROM lq)"""


def merged_sql(spans: str) -> str:
    """CTE merged of spans (pair_id, start, stop, text, risk, n, source)."""
    return f"""mo AS (SELECT *, max(stop) OVER (PARTITION BY pair_id ORDER BY start, stop, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {spans}),
    mg AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY start, stop, source ROWS UNBOUNDED PRECEDING) AS part FROM mo),
    merged AS (SELECT pair_id, min(start) AS start, max(stop) AS stop, arg_min(text, (start, stop, source)) AS text, max(risk) AS risk, sum(n) AS n, CASE WHEN count(DISTINCT source) > 1 THEN 'rule' ELSE any_value(source) END AS source FROM mg GROUP BY pair_id, part)"""


MARKS = [(p, i, s, s + n) for p, _, answer in cases.PAIRS for i, (s, n) in enumerate([(0, 4), (10, 9), (36, 6), (50, 12), (70, 3)]) if s + n <= len(answer)]


@query(f"WITH {PAIRS_SQL}, {cases.values_sql('marks', 'pair_id, sid, start, stop', MARKS)}, sp AS (SELECT *, start AS ks, stop AS ke FROM marks), {clauses_sql('cases', 'sp')} SELECT pair_id, ks::BIGINT AS keep_start, start::BIGINT AS start, stop::BIGINT AS \"end\" FROM clause")
def clause_bounds(spark, sf):
    marks = spark.createDataFrame(MARKS, "pair_id string, sid int, start int, end int").withColumn("keep_start", F.col("start")).withColumn("keep_end", F.col("end"))
    out = sh.clauses(marks, cases.pairs(spark))
    return out.select("pair_id", F.col("keep_start").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"))


@query(f"WITH {PAIRS_SQL}, {cases.values_sql('marks', 'pair_id, sid, start, stop', MARKS)}, {sentences_sql('ase', 'cases', 'answer')} SELECT m.pair_id, sid::BIGINT AS sid, a.start::BIGINT AS start, greatest(a.stop, m.stop)::BIGINT AS \"end\" FROM marks m JOIN ase a ON a.pair_id = m.pair_id AND a.start <= m.start AND m.start < a.stop")
def sentence_bounds(spark, sf):
    marks = spark.createDataFrame(MARKS, "pair_id string, sid int, start int, end int")
    out = sh.in_sentences(marks, cases.pairs(spark))
    return out.select("pair_id", F.col("sid").cast("long"), F.col("s_start").cast("long").alias("start"), F.col("s_end").cast("long").alias("end"))


SPANS = [
    ("a", 0, 10, "first", 0.4, "doubtful", 2, "mask"), ("a", 10, 12, "touch", 0.8, "likely_hallucination", 1, "mask"), ("a", 20, 25, "x 5", 0.5, "doubtful", 1, "attribution"), ("a", 22, 30, "y", 0.45, "doubtful", 3, "mask"),
    ("b", 5, 40, "long fragment of the mask", 0.5, "doubtful", 5, "mask"), ("b", 6, 8, "in", 0.76, "likely_hallucination", 1, "mask"), ("c", 3, 4, "7", 0.5, "doubtful", 1, "mask"), ("c", 9, 12, "abc", 0.5, "doubtful", 1, "coverage"), ("d", 0, 3, "one", 0.36, "doubtful", 1, "mask"),
]
SPANS_SQL = cases.values_sql("spans0", "pair_id, start, stop, text, risk, label, n, source", SPANS)


def _spans(spark):
    return spark.createDataFrame(SPANS, "pair_id string, start int, end int, text string, risk double, label string, n_tokens long, source string")


@query(f"WITH {SPANS_SQL}, {merged_sql('spans0')} SELECT pair_id, start::BIGINT AS start, stop::BIGINT AS \"end\", text, risk::DOUBLE AS risk, CASE WHEN risk >= 0.75 THEN 'likely_hallucination' ELSE 'doubtful' END AS label, n::BIGINT AS n_tokens, source FROM merged")
def merged_spans(spark, sf):
    return sh.merged(_spans(spark)).withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


@query(f"WITH {SPANS_SQL} SELECT pair_id, start::BIGINT AS start, text FROM spans0 WHERE length(trim(text)) >= 5 OR regexp_matches(text, '[0-9]')")
def long_or_numeric_spans(spark, sf):
    return sh.without_short(_spans(spark), 5).select("pair_id", F.col("start").cast("long"), "text")


EVIDENCE = f"""{SPANS_SQL}, ev AS (SELECT pair_id, count(*) AS total, count(*) FILTER (source = 'mask') AS masks, coalesce(sum(n) FILTER (source = 'mask'), 0) AS tokens, coalesce(max(length(text)) FILTER (source = 'mask'), 0) AS chars, count(*) FILTER (source <> 'mask') AS texts FROM spans0 GROUP BY 1),
    sc(pair_id, score, scored) AS (VALUES ('a', 0.3, 9), ('b', 0.3, 60), ('c', 0.2, 4), ('d', 0.3, 3), ('e', 0.7, 3), ('f', 0.1, 0)), j AS (SELECT sc.*, coalesce(total, 0) AS total, coalesce(masks, 0) AS masks, coalesce(tokens, 0) AS tokens, coalesce(chars, 0) AS chars, coalesce(texts, 0) AS texts FROM sc LEFT JOIN ev USING (pair_id))"""
_PARAMS = {"min_mask_tokens": 1, "min_fragment_chars": 3, "min_flagged_share": 0.1, "text_rule_decisive": False}


def _evidence(spark):
    scores = spark.createDataFrame([("a", 0.3, 9), ("b", 0.3, 60), ("c", 0.2, 4), ("d", 0.3, 3), ("e", 0.7, 3), ("f", 0.1, 0)], "pair_id string, score double, scored_tokens long").withColumn("threshold", F.lit(0.5))
    return scores.join(sh.evidence(_spans(spark)), "pair_id", "left").fillna(0)


@query(f"""WITH {EVIDENCE} SELECT pair_id, CASE WHEN score >= 0.5 THEN 'likely_hallucination' WHEN total > 0 THEN 'doubtful' ELSE 'grounded' END AS any_span, CASE WHEN score >= 0.5 THEN 'likely_hallucination' WHEN texts > 0 OR tokens >= 2 THEN 'doubtful' ELSE 'grounded' END AS min_two_tokens,
    CASE WHEN score >= 0.5 THEN 'likely_hallucination' WHEN texts > 0 OR (tokens >= 2 AND chars >= 20) THEN 'doubtful' ELSE 'grounded' END AS corroborated, CASE WHEN score >= 0.5 THEN 'likely_hallucination' WHEN tokens >= 1 AND chars >= 3 AND tokens / greatest(scored, 1) >= 0.1 THEN 'doubtful' ELSE 'grounded' END AS loosened FROM j""")
def verdict_rules(spark, sf):
    out = _evidence(spark)
    return out.select("pair_id", *(sh.verdict(r).alias(r) for r in ("any_span", "min_two_tokens", "corroborated")), sh.verdict(params=_PARAMS).alias("loosened"))


@query(f"WITH {EVIDENCE} SELECT pair_id, total::BIGINT AS spans_total, masks::BIGINT AS mask_spans, tokens::BIGINT AS mask_tokens, chars::BIGINT AS max_fragment_chars, texts::BIGINT AS text_spans, score >= 0.5 OR texts > 0 OR (tokens >= 2 AND chars >= 20) AS flag, score >= 0.5 OR total > 0 AS legacy FROM j")
def verdict_evidence(spark, sf):
    out = _evidence(spark).withColumns({"flag": sh.is_doubted(), "legacy": sh.is_doubted("any_span")})
    return out.select("pair_id", "spans_total", "mask_spans", "mask_tokens", F.col("max_fragment_chars").cast("long"), "text_spans", "flag", "legacy")


# ---- verification in full

GROUPS = f"""{_FEATURES}, beside AS (SELECT pair_id, idx, start, "end", lag(start) OVER o AS lag_start, lead("end") OVER o AS lead_end FROM smooth WINDOW o AS (PARTITION BY pair_id ORDER BY idx)),
    grp AS (SELECT f.pair_id, isle::VARCHAR AS sid, min(f.start) AS ks, max(f."end") AS ke, min(f.start) AS start, max(f."end") AS stop, max(s) AS risk, count(*) AS n, arg_min(coalesce(lag_start, f.start), idx) AS before, arg_max(coalesce(lead_end, f."end"), idx) AS after FROM flagged f JOIN beside USING (pair_id, idx) GROUP BY f.pair_id, isle)"""
FULL = f"""{GROUPS}, {clauses_sql('pairs', 'grp')}, cl AS (SELECT pair_id, start, stop, substr(answer, start::INT + 1, (stop - start)::INT) AS text, risk, n, 'mask' AS source FROM clause), {merged_sql('cl')},
    ev AS (SELECT pair_id, count(*) AS n_spans, sum(n) AS mask_tokens, max(length(text)) AS longest FROM merged GROUP BY pair_id),
    ins AS (SELECT s.pair_id, s.idx, s.s, l.span_threshold, EXISTS (SELECT 1 FROM merged m WHERE m.pair_id = s.pair_id AND m.start <= s.start AND s.start < m.stop) AS inside FROM smooth s JOIN lim l USING (pair_id) WHERE scored),
    sh AS (SELECT pair_id, avg(CASE WHEN inside THEN 1 ELSE s END) AS soft, avg(CASE WHEN inside OR s >= span_threshold THEN 1.0 ELSE 0 END) AS hard FROM ins GROUP BY pair_id)"""


@query(f"""WITH {GROUPS}, {clauses_sql('pairs', 'grp')}, capped AS (SELECT pair_id, sid, ks, ke, start, stop, greatest(40, 2 * (ke - ks)) AS most, floor((ks + ke) / 2) AS mid FROM clause),
    cc AS (SELECT pair_id, sid, CASE WHEN stop - start > most THEN least(greatest(start, mid - floor(most / 2)), ks) ELSE start END AS a, CASE WHEN stop - start > most THEN greatest(least(stop, greatest(start, mid - floor(most / 2)) + most), ke) ELSE stop END AS b FROM capped)
    SELECT g.pair_id, g.ks::BIGINT AS start, g.before::BIGINT AS padded_start, g.after::BIGINT AS padded_end, c.start::BIGINT AS clause_start, c.stop::BIGINT AS clause_end, a::BIGINT AS capped_start, b::BIGINT AS capped_end FROM grp g JOIN clause c USING (pair_id, sid) JOIN cc USING (pair_id, sid)""")
def span_expansions(spark, sf):
    p = pairs(spark, sf)
    groups = sh.mask_groups(vf.spanned(vf.token_risks(p)))
    out = groups.select("pair_id", "keep_start", "risk", F.col("keep_start").cast("long").alias("start"), F.col("before").cast("long").alias("padded_start"), F.col("after").cast("long").alias("padded_end"))
    moved = sh.clauses(groups.withColumn("start", F.col("keep_start")).withColumn("end", F.col("keep_end")), p)
    both = moved.select("pair_id", "keep_start", F.col("start").cast("long").alias("clause_start"), F.col("end").cast("long").alias("clause_end"))
    capped = sh.capped(moved).select("pair_id", "keep_start", F.col("start").cast("long").alias("capped_start"), F.col("end").cast("long").alias("capped_end"))
    return out.join(both, ["pair_id", "keep_start"]).join(capped, ["pair_id", "keep_start"]).drop("keep_start", "risk")


@query(f"""WITH {FULL} SELECT p.pair_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_scored, 0)::BIGINT AS n_scored, round(coalesce(score, 0), 6)::DOUBLE AS score, coalesce(n_spans, 0)::BIGINT AS n_spans, round(coalesce(soft, 0), 6)::DOUBLE AS ai_share_soft, round(coalesce(hard, 0), 6)::DOUBLE AS ai_share_hard,
        CASE WHEN coalesce(n_tokens, 0) = 0 THEN 'empty' WHEN round(score, 9) >= 0.5 THEN 'likely_hallucination' WHEN mask_tokens >= 2 AND longest >= 20 THEN 'doubtful' ELSE 'grounded' END AS verdict
    FROM pairs p LEFT JOIN scores USING (pair_id) LEFT JOIN lim USING (pair_id) LEFT JOIN ev USING (pair_id) LEFT JOIN sh USING (pair_id)""")
def verified(spark, sf):
    """Every assistant turn with its spans and shares; the tables hold no numbers that belong to other subjects."""
    out = vf.verified(pairs(spark, sf))
    return out.select("pair_id", "n_tokens", "n_scored", F.round("score", 6).alias("score"), F.size("spans").cast("long").alias("n_spans"), F.round("ai_share_soft", 6).alias("ai_share_soft"), F.round("ai_share_hard", 6).alias("ai_share_hard"), "verdict")


@query(f"""WITH {FULL} SELECT s.pair_id, idx::BIGINT AS "index", trim(text, {BLANKS}) AS text, start::BIGINT AS start, round(s, 4)::DOUBLE AS risk, scored AND s >= span_threshold AS flagged,
    CASE WHEN scored AND s >= span_threshold AND s >= 0.75 THEN 'likely_hallucination' WHEN scored AND s >= span_threshold THEN 'doubtful' ELSE 'ok' END AS label FROM smooth s JOIN lim USING (pair_id)""")
def token_rows(spark, sf):
    rows = vf.spanned(vf.token_risks(pairs(spark, sf))).where("span_threshold < 1")
    return sh.token_payload(rows).select("pair_id", F.col("index").cast("long"), "text", F.col("start").cast("long"), "risk", "flagged", "label")


@query()
def verified_cases(spark, sf):
    """The typed-in pairs, whose verdicts rest on numbers and facts; tests hold the expected ones."""
    out = vf.verified(cases.pairs(spark))
    return out.select("pair_id", "verdict", F.size("spans").alias("n_spans"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["source"]))).alias("sources"))
