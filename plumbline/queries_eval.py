"""Queries of reports: aggregators, oracles, grids, bootstraps, shares of fragments, corpus counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx
from plumbline.operators import corpus
from plumbline.operators import evaluation as ev
from plumbline.operators import features as ft
from plumbline.operators import metrics as mt
from plumbline.operators import shaping as sh
from plumbline.plans import verify as vf
from plumbline.queries import _FEATURES, _VOCAB, BLANKS, PAIRS, SCORED, SENTENCES, content_sql, pairs, plain_sql, query, scored_docs, scored_sql, table, tokens_sql
from plumbline.queries_spans import FULL, sentences_sql

RATIOS = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4)::DOUBLE AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4)::DOUBLE AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4)::DOUBLE AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 4)::DOUBLE AS fpr"""
COUNTS = "count(*) FILTER (y AND said)::BIGINT AS tp, count(*) FILTER (NOT y AND said)::BIGINT AS fp, count(*) FILTER (y AND NOT said)::BIGINT AS fn, count(*) FILTER (NOT y AND NOT said)::BIGINT AS tn"


def _risks(spark, sf):
    return vf.token_risks(pairs(spark, sf))


@query(f"""WITH {_FEATURES}, v AS (SELECT pair_id, list_sort(list(s) FILTER (scored), 'DESC') AS v FROM smooth GROUP BY pair_id) SELECT pair_id, round(CASE WHEN len(coalesce(v, [])) > 0 THEN 0.5 * list_avg(v) + 0.5 * list_avg(v[1:greatest(1, floor(len(v) * 0.2::DOUBLE + 1e-9)::INT)]) ELSE 0 END, 6)::DOUBLE AS current,
    round(coalesce(v[1], 0), 6)::DOUBLE AS max, round(coalesce(list_avg(v[1:3]), 0), 6)::DOUBLE AS mean_top3 FROM v""")
def answer_aggregators(spark, sf):
    rows = _risks(spark, sf).withColumn("r", F.when(F.col("scored"), F.col("smooth")))
    out = ev.aggregated(rows, "pair_id", "r")
    return out.select("pair_id", *(F.round(c, 6).alias(c) for c in ("current", "max", "mean_top3")))


@query(f"WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')} SELECT pair_id, max(CASE WHEN length(text) > 9 THEN 1 ELSE 0 END)::INT AS label FROM tok GROUP BY pair_id")
def answer_labels(spark, sf):
    toks = tx.tokens(pairs(spark, sf), ["pair_id"], "answer").withColumn("y", (F.length("text") > 9).cast("int"))
    return ev.answer_labels(toks, "pair_id", "y")


@query(f"WITH {SCORED}, x AS (SELECT lang, label = 1 AS y, score >= 0.6 AS said FROM scored), c AS (SELECT lang, {COUNTS} FROM x GROUP BY lang), m AS (SELECT *, {RATIOS} FROM c) SELECT lang, tp, fp, fn, tn, precision, recall, f1, fpr, CASE WHEN f1 >= 0.5 AND fpr <= 0.4 THEN 'reached' ELSE 'not reached' END AS contract, CASE WHEN f1 >= 0.9 AND fpr <= 0.1 THEN 'reached' ELSE 'not reached' END AS internal FROM m")
def metrics_by_language(spark, sf):
    """Confusion of each language, as reports hold it, and two gates."""
    out = mt.confusion(scored_docs(spark, sf), F.col("label"), F.col("score") >= 0.6, ["lang"])
    out = ev.gate_report(ev.rounded(out, ["precision", "recall", "f1", "fpr"]), {"contract": (0.5, 0.4), "internal": (0.9, 0.1)})
    return out.drop("accuracy")


@query(f"WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')}, p AS (SELECT pair_id, idx, start, \"end\" + idx % 3 AS stop FROM tok WHERE idx % 5 = 0), g AS (SELECT pair_id, start, \"end\" AS stop FROM tok WHERE idx % 3 = 0), m AS (SELECT g.pair_id, g.start, g.stop, arg_min(p.stop - p.start, idx) AS w FROM g JOIN p ON p.pair_id = g.pair_id AND p.start <= g.start AND p.stop >= g.stop GROUP BY ALL) SELECT count(*)::BIGINT AS covered, round(avg(w / greatest(1, stop - start)), 6)::DOUBLE AS width_ratio FROM m")
def span_widths(spark, sf):
    toks = tx.tokens(pairs(spark, sf), ["pair_id"], "answer")
    said = toks.where("idx % 5 = 0").select("pair_id", F.col("idx").alias("order"), "start", (F.col("end") + F.col("idx") % 3).alias("end"))
    out = ev.width_ratio(said, toks.where("idx % 3 = 0"), "pair_id")
    return out.select("covered", F.round("width_ratio", 6).alias("width_ratio"))


@query(f"""WITH {_FEATURES}, o AS (SELECT pair_id, start, "end" AS stop, max("end") OVER (PARTITION BY pair_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM smooth WHERE s >= 0.45),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS part FROM o) SELECT pair_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS "end" FROM g GROUP BY pair_id, part""")
def predicted_spans(spark, sf):
    out = ev.predicted_spans(_risks(spark, sf), "pair_id", "smooth", 0.45)
    return out.select("pair_id", F.col("start").cast("long"), F.col("end").cast("long"))


_CURVE = f"{SCORED}, b AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY score), c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p FROM b)"


@query(f"WITH {_CURVE} SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, round(2 * tp / (p + tp + fp), 6)::DOUBLE AS f1 FROM c ORDER BY 2 * tp / (p + tp + fp) DESC, score DESC LIMIT 1")
def threshold_oracle(spark, sf):
    return ev.oracle(scored_docs(spark, sf), "score", "label").withColumn("f1", F.round("f1", 6))


@query(f"WITH {_FEATURES}, l AS (SELECT CASE WHEN length(text) > 6 THEN 1 ELSE 0 END AS y, entropy, mass, mass_norm, max_sim, density FROM risky WHERE scored), u AS (UNPIVOT l ON entropy, mass, mass_norm, max_sim, density INTO NAME feature VALUE value), b AS (SELECT feature, value::DOUBLE AS value, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM u GROUP BY ALL), w AS (SELECT feature, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS wins FROM b) SELECT feature, round(sum(wins) / (sum(pos) * sum(neg)), 6)::DOUBLE AS auc, round(1 - sum(wins) / (sum(pos) * sum(neg)), 6)::DOUBLE AS auc_inverted FROM w GROUP BY feature")
def feature_signs(spark, sf):
    """Which of the working features tells long tokens."""
    rows = ft.token_features(pairs(spark, sf)).where("scored").withColumn("y", (F.length("text") > 6).cast("int"))
    out = ev.sign_audit(rows, list(lex.WEIGHTS), "y")
    return out.select("feature", F.round("auc", 6).alias("auc"), F.round("auc_inverted", 6).alias("auc_inverted"))


@query(f"WITH {_FEATURES} SELECT mass >= 1 AS supported, count(*)::BIGINT AS n, round(median(density), 6)::DOUBLE AS median_density, round(avg(density), 6)::DOUBLE AS mean_density FROM risky WHERE scored GROUP BY 1")
def density_reference(spark, sf):
    rows = ft.token_features(pairs(spark, sf)).where("scored")
    return rows.groupBy((F.col("mass") >= 1).alias("supported")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("density"), 6).alias("median_density"), F.round(F.avg("density"), 6).alias("mean_density"))


@query(f"WITH {_VOCAB}, s AS (SELECT pair_id, substr({plain_sql('text')}, 1, 4) AS stem FROM ta WHERE {scored_sql('text')}), k AS (SELECT DISTINCT pair_id, substr({plain_sql('text')}, 1, 4) AS stem FROM tc WHERE {content_sql('text')}) SELECT s.pair_id, round(avg(CASE WHEN k.stem IS NULL THEN 0 ELSE 1 END), 6)::DOUBLE AS ratio FROM s LEFT JOIN k USING (pair_id, stem) GROUP BY s.pair_id")
def overlap_ratio(spark, sf):
    """The share of an answer's scored tokens whose stem is in the context."""
    p = pairs(spark, sf)
    said = p.select("pair_id", F.explode(tx.token_array(F.col("answer"))).alias("t")).where(tx.is_scored(F.col("t"))).select("pair_id", tx.stem(F.col("t")).alias("stem"))
    known = p.select("pair_id", F.explode(tx.token_array(F.col("context"))).alias("t")).where(tx.is_content(F.col("t"))).select("pair_id", tx.stem(F.col("t")).alias("stem")).distinct().withColumn("met", F.lit(True))
    out = ev.overlap_ratio(said.join(known, ["pair_id", "stem"], "left"), "pair_id", F.coalesce("met", F.lit(False)))
    return out.select("pair_id", F.round("ratio", 6).alias("ratio"))


_WEIGHTS = "w(replicate, source, weight) AS (SELECT r, s.source, (r * 7 + ascii(right(s.source, 1))) % 3 FROM (SELECT DISTINCT source FROM scored WHERE source IS NOT NULL) s, range(4) t(r))"


@query(f"""WITH {SCORED}, {_WEIGHTS}, j AS (SELECT replicate, weight, label = 1 AS y, score >= 0.6 AS said, score, label, least(9, greatest(0, floor(score * 10))) AS bin FROM scored JOIN w USING (source)),
    b AS (SELECT replicate, bin, sum(weight) AS n, sum(weight * label) AS pos, sum(weight * score) AS sc FROM j GROUP BY ALL), e AS (SELECT replicate, CASE WHEN sum(n) > 0 THEN sum(abs(pos - sc)) / sum(n) ELSE 0 END AS ece FROM b GROUP BY 1),
    c AS (SELECT replicate, sum(weight) FILTER (y AND said) AS tp, sum(weight) FILTER (NOT y AND said) AS fp, sum(weight) FILTER (y AND NOT said) AS fn, sum(weight) FILTER (NOT y AND NOT said) AS tn, sum(weight * (label - score) ** 2) / sum(weight) AS brier FROM j GROUP BY 1)
    SELECT replicate::BIGINT AS replicate, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / (tp + fn), 6)::DOUBLE AS recall, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1, round(fp / (fp + tn), 6)::DOUBLE AS fpr, round(brier, 6)::DOUBLE AS brier, round(ece, 6)::DOUBLE AS ece FROM c JOIN e USING (replicate)""")
def weighted_resamples(spark, sf):
    """Metrics of sources drawn a given number of times."""
    docs = scored_docs(spark, sf).where("source is not null")
    sums = ev.group_sums(docs, "source", "score", "label", 0.6)
    weights = docs.select("source").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("weight", (F.col("replicate") * 7 + F.ascii(F.right("source", F.lit(1)))) % 3)
    out = ev.weighted_metrics(sums, weights, "source")
    return out.select(F.col("replicate").cast("long"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr", "brier", "ece")))


@query(f"WITH {SCORED} SELECT a.lang AS positive, b.lang AS negative, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE AS wins FROM scored a JOIN scored b ON a.label = 1 AND b.label <> 1 WHERE a.lang IS NOT NULL AND b.lang IS NOT NULL GROUP BY ALL")
def auc_pair_matrix(spark, sf):
    return ev.pair_matrix(scored_docs(spark, sf).where("lang is not null"), "lang", "score", "label")


@query(f"""WITH {_FEATURES}, {sentences_sql('ase', 'pairs', 'answer')}, sc AS (SELECT pair_id, start, s FROM smooth WHERE scored), f AS (SELECT sc.pair_id, idx, avg(s) AS m FROM sc JOIN ase a ON a.pair_id = sc.pair_id AND a.start <= sc.start AND sc.start < a.stop GROUP BY ALL),
    g AS (SELECT pair_id, avg(m) AS m FROM f GROUP BY 1) SELECT t.pair_id, round(greatest(0, least(1, coalesce(any_value(g.m), avg(s)))), 6)::DOUBLE AS share FROM sc t LEFT JOIN g USING (pair_id) GROUP BY t.pair_id""")
def fragment_shares(spark, sf):
    """The mean over sentences of the mean risk of their scored tokens."""
    p = pairs(spark, sf)
    risks = vf.token_risks(p).where("scored")
    out = ev.fragment_share(risks, tx.sentences(p, ["pair_id"], "answer"), "pair_id", "smooth")
    return out.select("pair_id", F.round("share", 6).alias("share"))


@query()
def calibrated_shares(spark, sf):
    """Monotone steps of the quality mark on the share of distinct words."""
    _, rows = ev.calibrated_shares(scored_docs(spark, sf).where("label is not null").withColumn("label", F.col("label").cast("double")), "score", "label")
    return rows.select("doc_id", F.round("calibrated", 6).alias("calibrated"))


@query()
def cross_validation(spark, sf):
    docs = scored_docs(spark, sf).where("label is not null").withColumn("fold", F.pmod("doc_id", F.lit(4)))
    return ev.cross_validated(docs, "score", "label", "fold", 4, 0.4)


_EVIDENCE = f"{FULL}, d AS (SELECT p.pair_id, coalesce(round(score, 9), 0) AS score, coalesce(n_scored, 0) AS n_scored, coalesce(mask_tokens, 0) AS mask_tokens, coalesce(longest, 0) AS longest, coalesce(n_spans, 0) AS n_spans, length(answer) % 2 = 1 AS y FROM pairs p LEFT JOIN scores USING (pair_id) LEFT JOIN lim USING (pair_id) LEFT JOIN ev USING (pair_id))"


def _evidence(spark, sf):
    p = pairs(spark, sf)
    from plumbline.scratch import written

    rows = written(vf.spanned(vf.token_risks(p)), "tokens")
    spans = sh.merged(sh.expanded(sh.mask_groups(rows), p.select("pair_id", "answer")))
    scores = vf.answer_scores(rows).withColumn("score", F.round("score", 9)).join(rows.groupBy("pair_id").agg(F.count_if("scored").alias("scored_tokens")), "pair_id")
    out = p.select("pair_id", (F.length("answer") % 2).alias("y")).join(scores, "pair_id", "left").join(sh.evidence(spans), "pair_id", "left").fillna(0)
    return written(out.withColumn("threshold", F.lit(0.5)), "evidence")


@query(f"""WITH {_EVIDENCE}, r AS (SELECT y, unnest([{{'rule': 'any_span', 'said': score >= 0.5 OR n_spans > 0}}, {{'rule': 'min_two_tokens', 'said': score >= 0.5 OR mask_tokens >= 2}}, {{'rule': 'corroborated', 'said': score >= 0.5 OR (mask_tokens >= 2 AND longest >= 20)}}], recursive := true) FROM d), c AS (SELECT rule, {COUNTS} FROM r GROUP BY rule) SELECT rule, tp, fp, fn, tn, {RATIOS} FROM c""")
def rule_report(spark, sf):
    """The three rules on the same evidence; whether an answer's length is odd is the label."""
    out = ev.rule_report(_evidence(spark, sf), "y")
    return ev.rounded(out, ["precision", "recall", "f1", "fpr"]).drop("accuracy")


_GRID = {"min_mask_tokens": (2, 6, 16), "min_fragment_chars": (0, 80, 300), "min_flagged_share": (0.0, 0.1, 0.3)}


@query(f"""WITH {_EVIDENCE}, g AS (SELECT * FROM (VALUES (2), (6), (16)) a(t), (VALUES (0), (80), (300)) b(f), (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE)) c(s)),
    r AS (SELECT t, f, s, y, score >= 0.5 OR (mask_tokens >= t AND longest >= f AND CASE WHEN n_scored > 0 THEN mask_tokens / n_scored ELSE 0 END >= s) AS said FROM d, g), c AS (SELECT t, f, s, {COUNTS} FROM r GROUP BY ALL), m AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1x, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fprx FROM c),
    st AS (SELECT *, CASE WHEN fprx <= 0.2 THEN 1 WHEN fprx <= 0.4 THEN 2 ELSE 3 END AS stage FROM m) SELECT t::INT AS min_mask_tokens, f::INT AS min_fragment_chars, s AS min_flagged_share, tp, fp, round(f1x, 6)::DOUBLE AS f1, round(fprx, 6)::DOUBLE AS fpr, stage::INT AS stage FROM st WHERE stage <= (SELECT min(stage) FROM st) ORDER BY f1x DESC, fprx, t DESC, f DESC, s LIMIT 5""")
def chosen_rules(spark, sf):
    """The best cells of a grid of rule parameters (the full grid has 810)."""
    cells = ev.rule_grid(_evidence(spark, sf), "y", _GRID)
    return ev.chosen(cells, 0.2, 5).select("min_mask_tokens", "min_fragment_chars", "min_flagged_share", "tp", "fp", F.round("f1", 6).alias("f1"), F.round("fpr", 6).alias("fpr"), "stage")


@query(f"""WITH {_FEATURES}, sc AS (SELECT pair_id, s, length(text) > 6 AS y FROM smooth WHERE scored), md AS (SELECT pair_id, median(s) AS m FROM sc GROUP BY 1), mad AS (SELECT pair_id, any_value(m) AS m, median(abs(s - m)) AS d FROM sc JOIN md USING (pair_id) GROUP BY 1),
    g AS (SELECT * FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) a(z), (VALUES (0.25::DOUBLE), (0.35::DOUBLE), (0.45::DOUBLE)) b(f), (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) c(c) WHERE f < c),
    r AS (SELECT z, f, c, y, s >= round(greatest(0, least(0.999::DOUBLE, c, greatest(m + z * 1.4826::DOUBLE * d, f))), 12) AS said FROM sc JOIN mad USING (pair_id), g), k AS (SELECT z, f, c, {COUNTS} FROM r GROUP BY ALL) SELECT z, f AS floor, c AS cap, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1, round(fp / (fp + tn), 6)::DOUBLE AS fpr FROM k""")
def mask_grid(spark, sf):
    """Masks by the three parameters of their threshold; long tokens are the label."""
    rows = _risks(spark, sf).where("scored").withColumn("y", (F.length("text") > 6).cast("int"))
    out = ev.mask_grid(rows, "y")
    return out.select("z", "floor", "cap", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), F.round("fpr", 6).alias("fpr"))


@query(f"WITH {PAIRS} SELECT count(*)::BIGINT AS pairs, round(avg(length(answer)), 1)::DOUBLE AS mean_answer_chars, round(avg(length(context)), 1)::DOUBLE AS mean_context_chars, (SELECT count(DISTINCT lower(trim(w, '.,;:!?—–'))) FROM (SELECT unnest(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '')) AS w FROM pairs))::BIGINT AS vocabulary FROM pairs")
def pair_statistics(spark, sf):
    return ev.statistics(pairs(spark, sf))


@query("SELECT field, value, count(*)::BIGINT AS n FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY ALL")
def field_totals(spark, sf):
    return ev.totals(table(spark, sf, "documents"), ["lang", "source"])


@query("WITH f AS (SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 150), h AS (SELECT doc_id FROM f ORDER BY sha256('42:split:' || doc_id), doc_id LIMIT 30) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM h) THEN 'dev' WHEN doc_id IN (SELECT doc_id FROM f) THEN 'test' ELSE 'background' END AS part FROM documents")
def hash_parts(spark, sf):
    return ev.hash_parts(table(spark, sf, "documents").select("doc_id"), "doc_id", 150, 30)


_QUOTAS = [(1500, 40), (120, 40), (10, 40), (700, 150)]
_MIX = {"faithful": 0.4, "swap": 0.2, "omission": 0.15, "invention": 0.15, "shift": 0.1}


@query()
def mode_quotas(spark, sf):
    """Quotas of modes; tests hold them against their bounds."""
    rows = [(t, m, n) for t, least in _QUOTAS for m, n in ev.quotas(t, _MIX, "faithful", least).items()]
    return spark.createDataFrame(rows, "target int, mode string, n int")


@query(f"WITH s0 AS (SELECT doc_id, {SENTENCES.format('text')} AS ss FROM documents), s AS (SELECT doc_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS idx FROM s0), k AS (SELECT * FROM s WHERE trim(text, {BLANKS}) <> '') SELECT doc_id, idx::BIGINT AS idx, right(string_agg(text, '') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 300) AS context FROM k")
def sentence_contexts(spark, sf):
    rows = tx.sentences(table(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", "idx", "text")
    return corpus.neighbourhood(rows, "doc_id", 300).select("doc_id", F.col("idx").cast("long"), F.col("around").alias("context"))
