"""Queries of checks, diagnostics and made pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import cases
from plumbline.cases import PAIRS_SQL, TEXTS_SQL
from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx
from plumbline.operators import checks as ck
from plumbline.operators import corpus
from plumbline.operators import coverage as cv
from plumbline.operators import detector, splits
from plumbline.operators import variants as vr
from plumbline.plans import verify as vf
from plumbline.queries import _FEATURES, BLANKS, PAIRS, SENTENCES, pairs, plain_sql, query, table, tokens_sql, words_sql
from plumbline.queries_spans import FACTS
from plumbline.scratch import written

_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"WITH {_DOCS} SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'no source' ELSE 'not in its source' END AS problem FROM d WHERE doc_id % 5 = 0 OR (doc_id % 3 = 0)")
def context_problems(spark, sf):
    docs = _docs(spark, sf)
    rows = docs.select(F.col("doc_id").alias("id"), "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.substring("text", 3, F.length("text"))).alias("context"))
    return ck.contexts_in_sources(rows, docs.where("doc_id % 5 <> 0"))


@query(f"WITH {_DOCS} SELECT doc_id AS id, contains(left(text, 5) || chr(1) || substr(text, 9), substr(text, 6, 3)) AS elsewhere FROM d")
def values_elsewhere(spark, sf):
    docs = _docs(spark, sf)
    rows = docs.select(F.col("doc_id").alias("id"), "doc_id", F.substring("text", 6, 3).alias("value"), F.lit(5).alias("start"), F.lit(8).alias("end"))
    return ck.values_outside(rows, docs)


@query("""WITH a AS (SELECT doc_id, lang, n_chars + doc_id % 4 AS n FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, lang, n_chars AS n FROM documents WHERE doc_id % 11 <> 0), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL AS na, b.doc_id IS NULL AS nb, a.n AS x, b.n AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id)
    SELECT doc_id, '' AS field, 'missing' AS problem FROM j WHERE na UNION ALL SELECT doc_id, '', 'not expected' FROM j WHERE nb UNION ALL SELECT doc_id, 'n', 'differs' FROM j WHERE NOT na AND NOT nb AND abs(x - y) > 1""")
def record_differences(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.where("doc_id % 7 <> 0").select("doc_id", "lang", (F.col("n_chars") + F.col("doc_id") % 4).alias("n"))
    b = docs.where("doc_id % 11 <> 0").select("doc_id", "lang", F.col("n_chars").alias("n"))
    return ck.differences(a, b, "doc_id", ["lang", "n"], 1)


@query("SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'twice' END AS problem FROM documents WHERE doc_id % 9 = 0 OR doc_id % 13 = 0 UNION ALL SELECT '-1', 'unknown' UNION ALL SELECT DISTINCT lang, 'in several folds' FROM documents WHERE lang IS NOT NULL AND doc_id % 9 <> 0")
def state_problems(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", (F.col("doc_id") % 5).alias("fold"))
    states = docs.where("doc_id % 9 <> 0")
    states = states.unionByName(states.where("doc_id % 13 = 0")).unionByName(spark.createDataFrame([(-1, None, 0)], "doc_id long, lang string, fold long"))
    out = ck.state_problems(states, docs, "doc_id", "lang", "fold")
    return out.where("name is not null")


@query("SELECT id, figures FROM (VALUES (1, ['0', '0,5', '0,50', '0,500', '0,5000', '0.5', '0.50', '0.500', '0.5000', '50', '50,0', '50,00', '50.0', '50.00']), (2, ['1', '1,0', '1,00', '1,000', '1,0000', '1.0', '1.00', '1.000', '1.0000', '100', '100,0', '100,00', '100.0', '100.00'])) t(id, figures)")
def figure_forms(spark, sf):
    return spark.createDataFrame([(1, 0.5), (2, 1.0)], "id int, value double").select("id", ck.roundings(F.col("value")).alias("figures"))


@query(f"WITH {TEXTS_SQL} SELECT DISTINCT id, f AS figure FROM (SELECT id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) AS f FROM cases) WHERE f NOT IN ('5', '5.0', '5.00', '5.000', '5.0000', '5,0', '5,00', '5,000', '5,0000', '500', '500.0', '500.00', '500,0', '500,00')")
def unsupported_figures(spark, sf):
    return ck.unsupported_figures(cases.texts(spark), spark.createDataFrame([(5.0,)], "value double"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def payload_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", ck.field_at(F.col("props"), "k").alias("value"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM orders")
def merged_fields(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return ck.merged_fields(rows.withColumn("value", F.lit("old")), rows.where("k % 3 = 0").withColumn("value", F.lit("new")), "k")


def _rouge(n: int) -> str:
    grams = lambda c: f"SELECT id, substr({c}, i, {n}) AS g, count(*) AS n FROM rc, range(1, 60) t(i) WHERE i <= length({c}) - {n - 1} GROUP BY ALL"
    return f"a{n} AS ({grams('reference')}), b{n} AS ({grams('candidate')}), o{n} AS (SELECT id, sum(least(a{n}.n, b{n}.n)) AS met FROM a{n} JOIN b{n} USING (id, g) GROUP BY id), r{n} AS (SELECT rc.id, CASE WHEN coalesce(met, 0) > 0 THEN 2 * (met / (length(candidate) - {n - 1})) * (met / (length(reference) - {n - 1})) / (met / (length(candidate) - {n - 1}) + met / (length(reference) - {n - 1})) ELSE 0 END AS rouge FROM rc LEFT JOIN o{n} USING (id))"


@query(f"WITH rc AS (SELECT n.n_nationkey * 10 + r.r_regionkey AS id, n.n_nationkey AS k, r.r_regionkey AS o, n.n_name AS reference, r.r_name AS candidate FROM nation n, region r), {_rouge(1)}, {_rouge(2)}, s AS (SELECT k, o, candidate, round((r1.rouge + r2.rouge) / 2, 9) AS rouge FROM rc JOIN r1 USING (id) JOIN r2 USING (id)) SELECT k, arg_max(candidate, (rouge, -o)) AS candidate, max(rouge)::DOUBLE AS rouge FROM s GROUP BY k")
def best_candidates(spark, sf):
    """The region whose name is most like a nation's."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("reference"))
    rows = n.join(table(spark, sf, "region").select(F.col("r_regionkey").alias("o"), F.col("r_name").alias("candidate")), F.lit(True))
    return ck.best_candidate(rows, "k", "reference", "candidate", "o").withColumn("rouge", F.round("rouge", 9))


_MARKED = f"{PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')}, p AS (SELECT pair_id, start, \"end\" + idx % 3 AS stop, CASE WHEN idx % 2 = 0 THEN 'mask' ELSE 'rule' END AS source FROM tok WHERE idx % 5 = 0), g AS (SELECT pair_id, start, \"end\" AS stop FROM tok WHERE idx % 4 = 1 AND length(pair_id) % 2 = 0)"


@query(f"""WITH {_MARKED}, b AS (SELECT p.pair_id, p.start, p.stop, p.source, count(g.pair_id) AS gold, max(CASE WHEN least(p.stop, g.stop) > greatest(p.start, g.start) THEN (least(p.stop, g.stop) - greatest(p.start, g.start)) / ((p.stop - p.start) + (g.stop - g.start) - (least(p.stop, g.stop) - greatest(p.start, g.start))) ELSE 0 END) AS best FROM p LEFT JOIN g USING (pair_id) GROUP BY ALL)
    SELECT source, count(*)::BIGINT AS predicted, count(*) FILTER (gold = 0)::BIGINT AS fp_clean, count(*) FILTER (gold > 0 AND best = 0)::BIGINT AS fp_dirty, count(*) FILTER (coalesce(best, 0) > 0 AND best < 0.5)::BIGINT AS low_iou, count(*) FILTER (coalesce(best, 0) >= 0.5)::BIGINT AS hits FROM b GROUP BY source""")
def span_diagnostics(spark, sf):
    p = pairs(spark, sf)
    toks = tx.tokens(p, ["pair_id"], "answer")
    said = toks.where("idx % 5 = 0").select("pair_id", "start", (F.col("end") + F.col("idx") % 3).alias("end"), F.when(F.col("idx") % 2 == 0, "mask").otherwise("rule").alias("source"))
    gold = toks.where("idx % 4 = 1 and length(pair_id) % 2 = 0").select("pair_id", "start", "end")
    return ck.span_diagnostics(said, gold, p)


@query(f"""WITH {_FEATURES}, z AS (SELECT *, length(text) > 6 AS y, s >= 0.5 AS said, lag(s) OVER o AS l1, lead(s) OVER o AS r1, lag(s, 2) OVER o AS l2, lead(s, 2) OVER o AS r2 FROM smooth WHERE scored WINDOW o AS (PARTITION BY pair_id ORDER BY idx))
    SELECT CASE WHEN y AND said THEN 'tp' WHEN y THEN 'fn' WHEN said THEN 'fp' ELSE 'tn' END AS outcome, count(*)::BIGINT AS n, round(avg(s), 6)::DOUBLE AS own, round(avg(list_avg(list_filter([l1, r1, l2, r2], lambda x: x IS NOT NULL))), 6)::DOUBLE AS beside FROM z GROUP BY 1""")
def neighbour_diagnostics(spark, sf):
    rows = vf.token_risks(pairs(spark, sf)).where("scored").withColumn("y", (F.length("text") > 6).cast("int")).withColumn("said", F.col("smooth") >= 0.5)
    out = ck.neighbour_diagnostics(rows, "pair_id", "idx", "smooth", "y", "said", 2)
    return out.select("outcome", "n", F.round("own", 6).alias("own"), F.round("beside", 6).alias("beside"))


@query(f"""WITH {_FEATURES}, t AS (SELECT pair_id, s, CASE WHEN length(text) > 9 THEN 1 ELSE 0 END AS y FROM smooth WHERE scored), l AS (SELECT 'token' AS level, y = 1 AS y, s >= 0.5 AS said FROM t UNION ALL SELECT 'answer', max(y) = 1, max(s) >= 0.5 FROM t GROUP BY pair_id)
    SELECT level, count(*) FILTER (y AND said)::BIGINT AS tp, count(*) FILTER (NOT y AND said)::BIGINT AS fp, count(*) FILTER (y AND NOT said)::BIGINT AS fn, count(*) FILTER (NOT y AND NOT said)::BIGINT AS tn FROM l GROUP BY level""".replace("t AS (SELECT pair_id, s,", "tk AS (SELECT pair_id, s,").replace("FROM t UNION", "FROM tk UNION").replace("FROM t GROUP", "FROM tk GROUP"))
def metric_levels(spark, sf):
    rows = vf.token_risks(pairs(spark, sf)).where("scored").withColumn("y", (F.length("text") > 9).cast("int"))
    return ck.levels(rows, "pair_id", "smooth", "y", 0.5).select("level", "tp", "fp", "fn", "tn")


@query(f"WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')}, w AS (SELECT *, (row_number() OVER (PARTITION BY pair_id ORDER BY start, idx) - 1) // 40 AS win FROM tok) SELECT pair_id, win::BIGINT AS win, min(idx)::BIGINT AS first, max(idx)::BIGINT AS last, min(start)::BIGINT AS start, max(\"end\")::BIGINT AS \"end\" FROM w GROUP BY ALL")
def character_windows(spark, sf):
    out = ck.character_windows(tx.tokens(pairs(spark, sf), ["pair_id"], "answer"), "pair_id", 40)
    return out.select("pair_id", F.col("window").cast("long").alias("win"), *(F.col(c).cast("long") for c in ("first", "last", "start", "end")))


@query()
def detected_sentences(spark, sf):
    docs = table(spark, sf, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    rows = written(detector.probabilities(docs, "id", "text").select("id", "pos", "start", "end", "probability"), "words")
    out = ck.to_sentences(detector.spans(rows, "id", 0.2), docs, rows, "id", "text", detector.LEAST_TOKENS)
    return out.select("id", F.col("start").cast("long"), F.col("end").cast("long"), "n_tokens", F.round("mean", 6).alias("mean"))


@query("SELECT id, stop, verdict FROM (VALUES (1, 8, 'machine'), (2, 3, 'mixed'), (3, 3, 'human')) t(id, stop, verdict)")
def closed_spans(spark, sf):
    rows = spark.createDataFrame([(1, "word?!). next", 4, 0.9), (2, "a ,b,c", 1, 0.45), (3, "abc", 3, 0.1)], "id int, text string, stop int, score double")
    return rows.select("id", ck.closed(F.col("text"), F.col("stop")).alias("stop"), ck.text_verdict(F.col("score"), 0.5).alias("verdict"))


# ---- made pairs

_MODE = "['faithful', 'value', 'omission', 'condition', 'invention'][1 + ('0x' || substr(sha256('42:' || pair_id || ':' || sentence), 1, 8))::BIGINT % 5]"
_MADE = f"""{FACTS}, mf AS (SELECT pair_id, sentence, text, value, (value_start - start)::INT AS at_, condition, {_MODE} AS wish, regexp_extract(value, '[0-9]+') AS digits, strpos(text, condition) AS cut FROM facts2),
    mv AS (SELECT *, CASE WHEN wish = 'value' AND digits = '' THEN 'faithful' WHEN wish = 'condition' AND (condition = '' OR cut <= 1) THEN 'faithful' ELSE wish END AS mode, regexp_replace(value, '[0-9]+', CASE WHEN digits = '' THEN '' ELSE (2 * digits::BIGINT + 1)::VARCHAR END, 'g') AS nv, left(text, at_) AS head, substr(text, at_ + length(value) + 1) AS tail FROM mf),
    made AS (SELECT *, CASE mode WHEN 'faithful' THEN text WHEN 'value' THEN head || nv || tail WHEN 'omission' THEN rtrim(head) || tail WHEN 'condition' THEN rtrim(left(text, cut - 1), ' ,;') || '.' ELSE rtrim(text) || '{vr.INVENTED}' END AS answer FROM mv)"""


@query(f"""WITH {PAIRS_SQL}, {_MADE} SELECT pair_id || '-' || sentence AS id, mode, answer, CASE mode WHEN 'value' THEN at_ WHEN 'omission' THEN length(rtrim(head)) WHEN 'condition' THEN 0 WHEN 'invention' THEN length(rtrim(text)) + 1 END::BIGINT AS start,
    CASE mode WHEN 'value' THEN at_ + length(nv) WHEN 'omission' THEN length(rtrim(head)) + length(tail) WHEN 'condition' THEN length(answer) WHEN 'invention' THEN length(rtrim(text)) + {len(vr.INVENTED)} END::BIGINT AS \"end\", sha256(context || chr(10) || answer) AS digest FROM made JOIN (SELECT pair_id, context FROM cases) USING (pair_id)""")
def made_pairs(spark, sf):
    rows = cases.pairs(spark)
    facts = cv.facts(rows).join(rows.select("pair_id", "context"), "pair_id").select(F.col("pair_id").alias("doc_id"), "sentence", "text", "value", (F.col("value_start") - F.col("start")).alias("at"), "condition", "context")
    out = vr.made_pairs(facts)
    return out.select("id", "mode", "answer", F.col("start").cast("long"), F.col("end").cast("long"), "digest")


@query(f"WITH {PAIRS_SQL}, {FACTS} SELECT pair_id, sentence::BIGINT AS sentence, 'Что сказано в документе о том, что такое ' || subject || '?' AS question, sha256('Документ:' || chr(10) || context || chr(10) || chr(10) || 'Вопрос: Что сказано в документе о том, что такое ' || subject || '?' || chr(10) || 'Ответь только по документу.') AS prompt, rtrim(left(text, (value_start - start)::INT), ' ,.;:—-') AS prefix FROM facts2 JOIN (SELECT pair_id, context FROM cases) USING (pair_id)")
def made_prompts(spark, sf):
    rows = cases.pairs(spark)
    facts = cv.facts(rows).join(rows.select("pair_id", "context"), "pair_id")
    asked = vr.question(F.col("subject"))
    return facts.select("pair_id", F.col("sentence").cast("long"), asked.alias("question"), F.sha2(vr.prompt(F.col("context"), asked), 256).alias("prompt"), vr.subject_prefix(F.col("text"), F.col("value_start") - F.col("start")).alias("prefix"))


@query("SELECT n, CASE WHEN n % 100 BETWEEN 11 AND 14 THEN 'лет' WHEN n % 10 = 1 THEN 'год' WHEN n % 10 BETWEEN 2 AND 4 THEN 'года' ELSE 'лет' END AS form FROM range(130) t(n)")
def unit_forms(spark, sf):
    return spark.range(130).select(F.col("id").alias("n"), vr.unit_form(F.col("id"), "год", "года", "лет").alias("form"))


@query("WITH p AS (SELECT x, row_number() OVER (ORDER BY sha256('42:' || x)) - 1 AS i FROM (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) t(x)), r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS n FROM documents) SELECT doc_id, x AS pick FROM r JOIN p ON i = n % 5")
def unused_picks(spark, sf):
    return vr.unused(table(spark, sf, "documents").select("doc_id"), list("abcde"), "doc_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY sha256('7:' || o_orderkey), o_orderkey) - 1 AS rank FROM orders")
def hash_ranks(spark, sf):
    return splits.ranked(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "7")


@query(f"WITH {PAIRS}, s0 AS (SELECT pair_id, answer, {SENTENCES.format('answer')} AS ss FROM pairs), s AS (SELECT pair_id, unnest(ss) AS t, generate_subscripts(ss, 1) AS i FROM s0), o AS (SELECT pair_id, sum(length(t)) OVER (PARTITION BY pair_id ORDER BY i) AS b, length(t) AS n FROM s) SELECT p.pair_id, coalesce(min(b - n), length(answer) // 2)::BIGINT AS start, coalesce(max(b), length(answer) // 2 + 5)::BIGINT AS \"end\" FROM pairs p LEFT JOIN o ON o.pair_id = p.pair_id AND b - n < length(answer) // 2 + 5 AND b > length(answer) // 2 GROUP BY p.pair_id, answer")
def whole_sentences(spark, sf):
    middle = F.floor(F.length("answer") / 2).cast("int")
    return pairs(spark, sf).select("pair_id", vr.full_sentence(F.col("answer"), middle, middle + 5).alias("s")).select("pair_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


# ---- the style detector, in SQL of its own

_LIKES = ", ".join(f"coalesce(CASE WHEN len(g) > 0 AND len({f}(g, {d}) OVER o) > 0 THEN len(list_intersect(g, {f}(g, {d}) OVER o)) / len(list_distinct(list_concat(g, {f}(g, {d}) OVER o))) END, 0)" for d in range(1, detector.NEIGHBOURS + 1) for f in ("lag", "lead"))
STYLE_SQL = f"""turns AS (SELECT conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'assistant'), {tokens_sql('st', '(SELECT id AS pair_id, text AS answer FROM turns)', 'pair_id', 'answer')},
    sw AS (SELECT pair_id AS id, start, "end" AS stop, {plain_sql('text')} AS word, row_number() OVER (PARTITION BY pair_id ORDER BY idx) AS pos FROM st WHERE regexp_matches(text, '^[\\p{{L}}\\p{{N}}_]')),
    sg AS (SELECT *, CASE WHEN word <> '' THEN list_distinct(list_transform(range(1, greatest(1, length(word)) + 1), lambda i: substr('^' || word || '$', i, 3))) ELSE [] END AS g, pos - lag(pos) OVER (PARTITION BY id, word ORDER BY pos) <= 12 AS again,
        coalesce(stddev_pop(length(word)) OVER n, 0) / greatest(1, avg(length(word)) OVER n) AS spread FROM sw WINDOW n AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
    sl AS (SELECT *, list_sort([{_LIKES}], 'DESC')[1:{detector.NEIGHBOURS}] AS best FROM sg WINDOW o AS (PARTITION BY id ORDER BY pos)),
    sr AS (SELECT *, {detector.PREDICTABILITY}::DOUBLE * least(1, 0.5::DOUBLE * CASE WHEN word IN ({words_sql([w.replace('ё', 'е') for w in lex.BOILERPLATE])}) THEN 1 ELSE 0 END + 0.2::DOUBLE * CASE WHEN again THEN 1 ELSE 0 END + 0.3::DOUBLE * greatest(0, 1 - spread)) + {detector.DENSITY}::DOUBLE * least(1, list_sum(best) / {detector.NEIGHBOURS} / {detector.DENSITY_LEVEL}::DOUBLE) AS raw, count(*) OVER (PARTITION BY id) AS n FROM sl),
    sp AS (SELECT *, CASE WHEN n < 3 THEN raw ELSE avg(raw) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {detector.SMOOTHING // 2} PRECEDING AND {detector.SMOOTHING // 2} FOLLOWING) END AS p FROM sr)"""


def _style_sql(threshold: float) -> str:
    return f"""WITH {STYLE_SQL}, fl AS (SELECT id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY id ORDER BY pos) <= {detector.MERGE_GAP + 1} THEN 0 ELSE 1 END AS fresh FROM sp WHERE p >= {threshold}), rn AS (SELECT id, pos, sum(fresh) OVER (PARTITION BY id ORDER BY pos) AS run FROM fl), ru AS (SELECT id, run, count(*) AS n FROM rn GROUP BY id, run HAVING count(*) >= {detector.LEAST_TOKENS}),
    rs AS (SELECT id, count(*) AS n_spans, sum(n) AS inside FROM ru GROUP BY id) SELECT sp.id, count(*)::BIGINT AS n_words, round(avg(p), 6)::DOUBLE AS score, round(coalesce(any_value(inside), 0) / count(*), 6)::DOUBLE AS share, coalesce(any_value(n_spans), 0)::BIGINT AS n_spans FROM sp LEFT JOIN rs USING (id) GROUP BY sp.id"""


def _style(spark, sf, threshold: float):
    docs = table(spark, sf, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    out = detector.analyze(docs, "id", "text", threshold)
    return out.select("id", "n_words", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"), "n_spans")


@query(_style_sql(detector.THRESHOLD))
def style_scores(spark, sf):
    """The style of every assistant turn."""
    return _style(spark, sf, detector.THRESHOLD)


@query(_style_sql(0.2))
def style_shares(spark, sf):
    """The same at a threshold low enough for spans."""
    return _style(spark, sf, 0.2)
