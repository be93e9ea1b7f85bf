"""Queries of learning, candidate spans, hashed vectors and long texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx
from plumbline.operators import candidates as cd
from plumbline.operators import features as ft
from plumbline.operators import learning as ln
from plumbline.operators import retrieval, vectors
from plumbline.operators import shaping as sh
from plumbline.plans import verify as vf
from plumbline.queries import _FEATURES, _SENT, _TERMS, BLANKS, PAIRS, pairs, query, table
from plumbline.queries_spans import sentences_sql
from plumbline.scratch import written

NAMES = list(lex.WEIGHTS)
EPOCHS = 6


def descent_sql(p: str, rows: str, n: int, epochs: int = EPOCHS, rate: float = 0.5, l2: float = 0.001) -> str:
    """CTEs {p}st (means, scales) and {p}w0 ... {p}w{epochs} (bias and weights) of rows(x0.., y)."""
    xs = range(n)
    out = f"{p}st AS (SELECT " + ", ".join(f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) > 0 THEN stddev_pop(x{i}) ELSE 1 END AS s{i}" for i in xs) + f" FROM {rows}), {p}z AS (SELECT y, " + ", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in xs) + f" FROM {rows}, {p}st), {p}w0 AS (SELECT 0.0::DOUBLE AS b, " + ", ".join(f"0.0::DOUBLE AS w{i}" for i in xs) + ")"
    for e in range(1, epochs + 1):
        prob = "1 / (1 + exp(-greatest(-30, least(30, b + " + " + ".join(f"w{i} * z{i}" for i in xs) + "))))"
        out += f", {p}g{e} AS (SELECT avg(q - y) AS gb, " + ", ".join(f"avg((q - y) * z{i}) AS g{i}" for i in xs) + f" FROM (SELECT *, {prob} AS q FROM {p}z, {p}w{e - 1})), {p}w{e} AS (SELECT b - {rate} * gb AS b, " + ", ".join(f"w{i} - {rate} * (g{i} + {l2} * w{i}) AS w{i}" for i in xs) + f" FROM {p}w{e - 1}, {p}g{e})"
    return out


def judged_sql(p: str, n: int, epochs: int = EPOCHS) -> str:
    return f"1 / (1 + exp(-greatest(-30, least(30, b + " + " + ".join(f"w{i} * (x{i} - m{i}) / s{i}" for i in range(n)) + "))))"


ROWS = f"{_FEATURES}, rws AS (SELECT pair_id, idx, entropy::DOUBLE AS x0, mass::DOUBLE AS x1, mass_norm::DOUBLE AS x2, max_sim::DOUBLE AS x3, density::DOUBLE AS x4, CASE WHEN length(text) > 6 THEN 1 ELSE 0 END AS y FROM risky WHERE scored)"


def _rows(spark, sf):
    rows = ft.token_features(pairs(spark, sf)).where("scored")
    return written(rows.withColumn("y", (F.length("text") > 6).cast("int")), "samples")


@query(f"WITH {ROWS}, {descent_sql('d', 'rws', 5)} SELECT * FROM (SELECT 'bias' AS name, round(b, 7)::DOUBLE AS weight, NULL::DOUBLE AS mean, NULL::DOUBLE AS scale FROM dw{EPOCHS} UNION ALL SELECT unnest(['entropy', 'mass', 'mass_norm', 'max_sim', 'density']), unnest([round(w0, 7), round(w1, 7), round(w2, 7), round(w3, 7), round(w4, 7)]), unnest([round(m0, 7), round(m1, 7), round(m2, 7), round(m3, 7), round(m4, 7)]), unnest([round(s0, 7), round(s1, 7), round(s2, 7), round(s3, 7), round(s4, 7)]) FROM dw{EPOCHS}, dst)")
def logistic_fit(spark, sf):
    """A model of long tokens after six epochs."""
    m = ln.logistic(_rows(spark, sf), NAMES, "y", epochs=EPOCHS)
    rows = [("bias", round(m.bias, 7), None, None)] + [(n, round(w, 7), round(a, 7), round(s, 7)) for n, w, a, s in zip(m.names, m.weights, m.means, m.scales, strict=True)]
    return spark.createDataFrame(rows, "name string, weight double, mean double, scale double")


@query(f"WITH {ROWS}, {descent_sql('d', 'rws', 5)} SELECT pair_id, count(*)::BIGINT AS n, round(avg({judged_sql('d', 5)}), 6)::DOUBLE AS probability FROM rws, dst, dw{EPOCHS} GROUP BY pair_id")
def head_probabilities(spark, sf):
    rows = _rows(spark, sf)
    m = ln.Linear.from_dict(ln.logistic(rows, NAMES, "y", epochs=EPOCHS).to_dict())
    return rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(m.column()), 6).alias("probability"))


_FOLD = "length(pair_id) % 2"
_HALVES = f"{ROWS}, fr AS (SELECT *, idx % 2 AS fold FROM rws), a0 AS (SELECT * FROM fr WHERE fold = 1), a1 AS (SELECT * FROM fr WHERE fold = 0), {descent_sql('p', 'a0', 5)}, {descent_sql('q', 'a1', 5)}, oof AS (SELECT fold, y, {judged_sql('p', 5)} AS q FROM fr, pst, pw{EPOCHS} WHERE fold = 0 UNION ALL SELECT fold, y, {judged_sql('q', 5)} FROM fr, qst, qw{EPOCHS} WHERE fold = 1)"


@query(f"WITH {_HALVES} SELECT fold::INT AS fold, count(*)::BIGINT AS n, round(avg(q), 6)::DOUBLE AS mean, round(sum(CASE WHEN y = 1 THEN q ELSE 0 END), 3)::DOUBLE AS positive FROM oof GROUP BY fold")
def out_of_fold(spark, sf):
    """Tokens scored by a model of the other half."""
    out = ln.out_of_fold(_rows(spark, sf).withColumn("fold", F.col("idx") % 2), NAMES, "y", "fold", 2, epochs=EPOCHS)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 6).alias("mean"), F.round(F.sum(F.when(F.col("y") == 1, F.col("probability")).otherwise(0.0)), 3).alias("positive"))


@query("SELECT (doc_id % 4)::INT AS fold, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS groups, sha256(string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS digest FROM documents GROUP BY 1")
def fold_receipts(spark, sf):
    return ln.fold_receipts(table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).cast("int").alias("fold")), "doc_id", "fold")


@query(f"""WITH {_FEATURES}, sp AS (SELECT pair_id, idx * 7 AS start, idx * 7 + 3 AS stop FROM risky WHERE idx % 5 = 0), tt AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS total FROM risky)
    SELECT pair_id, any_value(total)::BIGINT AS total, count(*)::BIGINT AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM sp WHERE sp.pair_id = tt.pair_id AND tt.start < sp.stop AND tt."end" > sp.start) THEN 1 ELSE 0 END)::BIGINT AS labelled, round(sum(risk), 5)::DOUBLE AS risk FROM tt WHERE scored GROUP BY pair_id""")
def token_samples(spark, sf):
    risks = written(ft.combined(ft.token_features(pairs(spark, sf))), "risks")
    marks = risks.where("idx % 5 = 0").select("pair_id", (F.col("idx") * 7).alias("start"), (F.col("idx") * 7 + 3).alias("end"))
    out = ln.token_samples(risks, marks)
    return out.groupBy("pair_id").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("labelled"), F.round(F.sum("risk"), 5).alias("risk"))


_CLICHES = " + ".join(f"contains(lower(a.text), '{c}')::INT" for c in lex.MACHINE_CLICHES)
_PART = f"{_FEATURES}, {sentences_sql('ase', 'pairs', 'answer')}, prt AS (SELECT r.pair_id, r.idx, entropy::DOUBLE AS x0, mass::DOUBLE AS x1, density::DOUBLE AS x2, least(1, ({_CLICHES}) / 2)::DOUBLE AS x3, least(1, length(a.text) / 120)::DOUBLE AS x4, CASE WHEN r.idx % 3 = 0 THEN 1 ELSE 0 END AS y FROM risky r JOIN ase a ON a.pair_id = r.pair_id AND a.start <= r.start AND r.start < a.stop WHERE scored)"


@query(f"WITH {_PART}, {descent_sql('d', 'prt', 5)} SELECT pair_id, round(greatest(0, least(1, avg({judged_sql('d', 5)}))), 6)::DOUBLE AS ai_participation FROM prt, dst, dw{EPOCHS} GROUP BY pair_id")
def participation(spark, sf):
    p = pairs(spark, sf)
    rows = written(ln.participation_rows(ft.token_features(p), p).withColumn("y", (F.col("idx") % 3 == 0).cast("int")), "participation")
    out = ln.participation(rows, ln.logistic(rows, ln.PARTICIPATION, "y", epochs=EPOCHS))
    return out.select("pair_id", F.round("ai_participation", 6).alias("ai_participation"))


@query()
def participation_auc(spark, sf):
    p = pairs(spark, sf)
    rows = written(ln.participation_rows(ft.token_features(p), p).withColumn("y", (F.col("idx") % 3 == 0).cast("int")).withColumn("fold", F.pmod(F.crc32(F.col("pair_id").cast("binary")), F.lit(2))), "participation")
    return ln.out_of_fold_auc(rows, ln.PARTICIPATION, "y", "fold", 2, epochs=EPOCHS)


# ---- candidate spans

_CAND = f"""{_FEATURES}, st AS (SELECT pair_id, idx, text, start, "end", s, lag(s) OVER o AS prior, lead(s) OVER o AS after FROM smooth WHERE scored WINDOW o AS (PARTITION BY pair_id ORDER BY idx)),
    lows AS (SELECT *, sum(CASE WHEN s < 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY idx) AS lw FROM st), gr AS (SELECT *, CASE WHEN idx - lag(idx) OVER o > 2 OR lw <> lag(lw) OVER o THEN 1 ELSE 0 END AS fresh FROM lows WHERE s >= 0.3 WINDOW o AS (PARTITION BY pair_id ORDER BY idx)),
    cp AS (SELECT *, sum(fresh) OVER (PARTITION BY pair_id ORDER BY idx) AS c FROM gr), gp AS (SELECT *, idx - lag(idx) OVER (PARTITION BY pair_id, c ORDER BY idx) - 1 AS gap FROM cp),
    ca AS (SELECT g.pair_id, min(g.start) AS start, max(g."end") AS stop, max(s) AS risk, count(*) AS scored_count, count(*) FILTER (s >= 0.6) AS seed_count, avg(s) AS mean_risk, min(s) AS min_risk, sum(s) AS risk_mass, max(idx) - min(idx) + 1 AS token_width, count(*) FILTER (gap > 0) AS bridged_gaps, coalesce(sum(gap), 0) AS bridged_tokens,
        arg_min(s - coalesce(prior, s), idx) AS left_gradient, arg_max(s - coalesce(after, s), idx) AS right_gradient FROM gp g GROUP BY g.pair_id, c HAVING count(*) FILTER (s >= 0.6) >= 1),
    rl AS (SELECT pair_id, 0 AS start, 12 AS stop, 'attribution' AS source FROM pairs WHERE length(answer) % 2 = 0 UNION ALL SELECT pair_id, 20, 30, 'coverage' FROM pairs WHERE length(answer) >= 30),
    cf AS (SELECT ca.*, length(answer) AS size, round(score, 9) AS score, coalesce((SELECT max(CASE WHEN source = 'attribution' THEN 1 ELSE 0 END) FROM rl WHERE rl.pair_id = ca.pair_id AND rl.start < ca.stop AND rl.stop > ca.start), 0) AS exact_anchor, EXISTS (SELECT 1 FROM rl WHERE rl.pair_id = ca.pair_id AND rl.start < ca.stop AND rl.stop > ca.start)::INT AS rule_tag FROM ca JOIN pairs USING (pair_id) JOIN scores USING (pair_id))"""


def _candidates(spark, sf):
    p = pairs(spark, sf)
    rows = written(vf.token_risks(p), "risks")
    answers = p.select("pair_id", "answer").join(vf.answer_scores(rows).withColumn("score", F.round("score", 9)), "pair_id")
    span = lambda a, b, source, c: p.where(c).select("pair_id", F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("").alias("text"), F.lit(0.5).alias("risk"), F.lit("doubtful").alias("label"), F.lit(1).cast("long").alias("n_tokens"), F.lit(source).alias("source"))
    rules = span(0, 12, "attribution", "length(answer) % 2 = 0").unionByName(span(20, 30, "coverage", "length(answer) >= 30"))
    return written(cd.candidates(rows, answers, rules, 0.3, 0.6, 1, 1), "candidates"), answers, rules, rows


@query(f"""WITH {_CAND} SELECT pair_id, start::BIGINT AS start, stop::BIGINT AS "end", scored_count::DOUBLE AS scored_count, seed_count::DOUBLE AS seed_count, round(mean_risk, 6)::DOUBLE AS mean_risk, round(risk_mass, 5)::DOUBLE AS risk_mass, token_width::DOUBLE AS token_width, bridged_gaps::DOUBLE AS bridged_gaps, bridged_tokens::DOUBLE AS bridged_tokens, round(left_gradient, 6)::DOUBLE AS left_gradient, round(right_gradient, 6)::DOUBLE AS right_gradient,
    exact_anchor::DOUBLE AS exact_anchor, rule_tag::DOUBLE AS rule_tag, round(start / size, 6)::DOUBLE AS relative_start, round(score, 6)::DOUBLE AS p1_calibrated_score FROM cf""")
def span_candidates(spark, sf):
    out = _candidates(spark, sf)[0]
    rounded = [F.round(c, 5 if c == "risk_mass" else 6).alias(c) for c in ("scored_count", "seed_count", "mean_risk", "risk_mass", "token_width", "bridged_gaps", "bridged_tokens", "left_gradient", "right_gradient", "exact_anchor", "rule_tag", "relative_start", "p1_calibrated_score")]
    return out.select("pair_id", F.col("start").cast("long"), F.col("end").cast("long"), *rounded)


_HEAD = {"mean": [0.0] * 19, "scale": [1.0] * 19, "coef": [0.1, 0.2] + [0.0] * 2 + [0.5] + [0.0] * 14, "intercept": -0.6}


@query(f"""WITH {_CAND}, kp AS (SELECT pair_id, start, stop, scored_count AS n, 'mask' AS source FROM cf WHERE 1 / (1 + exp(-(-0.6 + 0.1 * scored_count + 0.2 * seed_count + 0.5 * min_risk))) >= 0.6 AND length(trim(substr(answer_of, start::INT + 1, (stop - start)::INT), {BLANKS})) > 0), al AS (SELECT * FROM kp UNION ALL SELECT pair_id, start, stop, 1, source FROM rl),
    o AS (SELECT *, max(stop) OVER (PARTITION BY pair_id ORDER BY start, stop, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM al), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY start, stop, source ROWS UNBOUNDED PRECEDING) AS part FROM o),
    m AS (SELECT pair_id, min(start) AS start, max(stop) AS stop, sum(n) AS n, list_sort(list(DISTINCT source)) AS sources FROM g GROUP BY pair_id, part) SELECT pair_id, m.start::BIGINT AS start, m.stop::BIGINT AS "end", n::BIGINT AS n_tokens, sources FROM m JOIN pairs USING (pair_id) WHERE trim(substr(answer, m.start::INT + 1, (m.stop - m.start)::INT), {BLANKS}) <> ''""".replace("cf AS (SELECT ca.*,", "cf AS (SELECT ca.*, answer AS answer_of,"))
def filtered_candidates(spark, sf):
    found, answers, rules, _ = _candidates(spark, sf)
    out = cd.filtered(found, _HEAD, 0.6, rules, answers.select("pair_id", "answer"))
    return out.select("pair_id", F.col("start").cast("long"), F.col("end").cast("long"), "n_tokens", "sources")


@query(f"""WITH {_CAND}, gd AS (SELECT pair_id, start, "end" AS stop FROM smooth WHERE idx % 3 = 0), bs AS (SELECT c.pair_id, c.start, c.stop, max((least(c.stop, g.stop) - greatest(c.start, g.start)) / ((c.stop - c.start) + (g.stop - g.start) - (least(c.stop, g.stop) - greatest(c.start, g.start)))) AS share FROM ca c JOIN gd g ON g.pair_id = c.pair_id AND g.start < c.stop AND g.stop > c.start GROUP BY ALL)
    SELECT count(*)::BIGINT AS n, count(*) FILTER (share >= 0.5)::BIGINT AS hits FROM ca LEFT JOIN bs USING (pair_id, start, stop)""")
def candidate_labels(spark, sf):
    found, _, _, rows = _candidates(spark, sf)
    return cd.candidate_labels(found, rows.where("idx % 3 = 0").select("pair_id", "start", "end")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("hits"))


# ---- long texts and hashed vectors


@query(f"WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), p AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM (SELECT id, regexp_extract_all(text, '\\n\\s*\\n|\\n|[^\\n]+') AS ps FROM d)), s AS (SELECT *, sum(length(p)) OVER (PARTITION BY id ORDER BY i) AS stop FROM p) SELECT id AS doc_id, (stop - length(p))::BIGINT AS start, stop::BIGINT AS \"end\" FROM s WHERE trim(p, {BLANKS}) <> ''")
def line_paragraphs(spark, sf):
    out = retrieval.line_paragraphs(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"))


@query()
def long_segments(spark, sf):
    """Where each cut falls depends on the one before; tests hold it against a plain version."""
    out = retrieval.long_parts(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", F.col("part").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"))


@query(f"""WITH {PAIRS}, {_SENT}, d AS (SELECT pair_id, passage, {_TERMS.format('text')} AS ts FROM s1), tf AS (SELECT pair_id, passage, t AS term, count(*) AS tf FROM (SELECT pair_id, passage, unnest(ts) AS t FROM d) GROUP BY 1, 2, 3),
    df AS (SELECT pair_id, term, count(*) AS df FROM tf GROUP BY 1, 2), stt AS (SELECT pair_id, count(*) AS n, avg(len(ts)) AS mean FROM d GROUP BY 1), q AS (SELECT DISTINCT pair_id, claim, unnest({_TERMS.format('query')}) AS term FROM (SELECT pair_id, 0 AS claim, left(context, 200) AS query FROM pairs UNION ALL SELECT pair_id, 1, right(context, 200) FROM pairs)),
    sc AS (SELECT pair_id, claim, passage, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / mean))) AS score FROM q JOIN tf USING (pair_id, term) JOIN df USING (pair_id, term) JOIN d USING (pair_id, passage) JOIN stt USING (pair_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, claim ORDER BY round(score, 9) DESC, passage) AS rank FROM sc) SELECT DISTINCT pair_id, passage::BIGINT AS passage FROM r WHERE rank <= 2""")
def claim_passages(spark, sf):
    """The answer's sentences for two claims: the first and the last words of the question."""
    p = pairs(spark, sf)
    found = F.filter(tx.sentence_array(F.col("answer")), lambda x: F.btrim(x, F.lit(tx.BLANKS)) != "")
    passages = p.select("pair_id", F.posexplode(found).alias("passage", "text"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("claim"), F.left("context", F.lit(200)).alias("query")), F.struct(F.lit(1).alias("claim"), F.right("context", F.lit(200)).alias("query"))))
    claims = p.select("pair_id", ends.alias("c")).select("pair_id", "c.*")
    return retrieval.claim_passages(claims, passages, "pair_id", 2).select("pair_id", F.col("passage").cast("long"))


@query()
def hashed_vectors(spark, sf):
    """Words of answers as hashed vectors; tests hold them against their definition."""
    toks = tx.tokens(pairs(spark, sf), ["pair_id"], "answer").withColumn("word", tx.plain(F.col("text"))).where("word <> ''")
    out = vectors.hashed_vectors(toks, "pair_id", "idx")
    return out.select("pair_id", F.col("idx").cast("long"), F.size("vector").alias("places"), F.round(vectors.sparse_cosine(F.col("vector"), F.col("vector")), 6).alias("length"))
