"""Named queries over the driver's tables, each with DuckDB SQL of the same result where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx
from plumbline.functions.scales import rounded
from plumbline.operators import calibration, corpus, heads, metrics, retrieval, rules, sequence, spans, splits, vectors
from plumbline.operators import features as ft
from plumbline.plans import verify as vf
from plumbline.sources.pairs import pairs_of_conversations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- SQL fragments

TOKEN = r"(?:[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_ \t\n\x0B\f\r\x{A0}])[ \t\n\x0B\f\r\x{A0}]*"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
EDGES = "'" + lex.EDGES.replace("'", "''") + "'"


def words_sql(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def plain_sql(x: str) -> str:
    return f"trim(translate(lower(trim({x}, {BLANKS})), 'ё', 'е'), {EDGES})"


def edge_sql(x: str) -> str:
    return f"trim(trim({x}, {BLANKS}), {EDGES})"


def content_sql(x: str) -> str:
    return rf"(length({edge_sql(x)}) >= 3 OR regexp_matches({edge_sql(x)}, '^\p{{Nd}}+$'))"


def scored_sql(x: str) -> str:
    return rf"((length({plain_sql(x)}) >= 3 OR regexp_matches({plain_sql(x)}, '^\p{{Nd}}+$')) AND NOT ({plain_sql(x)} IN ({words_sql(lex.STOP_WORDS)}) AND length({plain_sql(x)}) <= 3) AND {plain_sql(x)} <> '')"


def number_sql(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lex.NUMBER_WORDS.items())
    word = plain_sql(edge_sql(x))
    return f"CASE WHEN regexp_matches({word}, '^[0-9]+$') THEN regexp_replace({word}, '^0+([0-9])', '\\1') ELSE CASE {word} {cases} END END"


def tokens_sql(name: str, table: str, key: str, column: str) -> str:
    """CTEs of tokens: (key, idx, text, start, end)."""
    return rf"""{name}0 AS (SELECT {key}, regexp_extract_all(coalesce({column}, ''), '{TOKEN}') AS ts, length(regexp_extract(coalesce({column}, ''), '^[ \t\n\x0B\f\r\x{{A0}}]*')) AS lead FROM {table}),
    {name}1 AS (SELECT {key}, lead, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS idx FROM {name}0),
    {name} AS (SELECT {key}, idx, text, lead + sum(length(text)) OVER (PARTITION BY {key} ORDER BY idx) - length(text) AS start, lead + sum(length(text)) OVER (PARTITION BY {key} ORDER BY idx) AS "end" FROM {name}1)"""


PAIRS = """pairs AS (SELECT a.conv_id || '-' || b.turn AS pair_id, a.text AS context, b.text AS answer
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""
SENTENCES = r"string_split(regexp_replace(coalesce({}, ''), '([.!?…][ \t]+)([«\"(]?[A-ZА-ЯЁ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"
#: Scores with labels: the share of a document's distinct words, and its quality mark.
SCORED = r"""scored AS (SELECT doc_id, round(len(list_distinct(ws)) / greatest(1, len(ws)), 4) AS score, quality AS label, lang, source FROM
    (SELECT d.doc_id, lang, source, quality, regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+') AS ws FROM documents d JOIN labels l ON d.doc_id = l.doc_id))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of_conversations(table(spark, sf_dir, "conversations"))


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    score = rounded(F.size(F.array_distinct(words)) / F.greatest(F.lit(1), F.size(words)), 4)
    return docs.select("doc_id", score.alias("score"), F.col("quality").alias("label"), "lang", "source")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- tokens, sentences, words


@query(rf"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS n_tokens FROM documents")
def tokens_per_doc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.token_array(F.col("text"))).cast("long").alias("n_tokens"))


@query(f'WITH {PAIRS}, {tokens_sql("tok", "pairs", "pair_id", "answer")} SELECT pair_id, idx::BIGINT AS idx, text, start::BIGINT AS start, "end"::BIGINT AS "end" FROM tok')
def token_offsets(spark, sf):
    return tx.tokens(pairs(spark, sf), ["pair_id"], "answer").select("pair_id", F.col("idx").cast("long"), "text", F.col("start").cast("long"), F.col("end").cast("long"))


@query(f"WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')} SELECT pair_id, count(*)::BIGINT AS n, count(*) FILTER ({scored_sql('text')})::BIGINT AS n_scored, count(*) FILTER ({content_sql('text')})::BIGINT AS n_content FROM tok GROUP BY pair_id")
def scored_tokens(spark, sf):
    toks = tx.tokens(pairs(spark, sf), ["pair_id"], "answer")
    return toks.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.is_scored(F.col("text"))).alias("n_scored"), F.count_if(tx.is_content(F.col("text"))).alias("n_content"))


@query(f"SELECT doc_id, len(list_filter({SENTENCES.format('text')}, lambda x: trim(x, {BLANKS}) <> ''))::BIGINT AS n_sentences FROM documents")
def sentences_per_doc(spark, sf):
    found = F.filter(tx.sentence_array(F.col("text")), lambda x: F.btrim(x, F.lit(tx.BLANKS)) != "")
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n_sentences"))


@query(f"""WITH {PAIRS}, s0 AS (SELECT pair_id, {SENTENCES.format('context')} AS ss FROM pairs), s1 AS (SELECT pair_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS idx FROM s0),
    s AS (SELECT *, sum(length(text)) OVER (PARTITION BY pair_id ORDER BY idx) AS stop FROM s1) SELECT pair_id, idx::BIGINT AS idx, (stop - length(text))::BIGINT AS start, stop::BIGINT AS "end" FROM s WHERE trim(text, {BLANKS}) <> ''""")
def sentence_offsets(spark, sf):
    found = tx.sentences(pairs(spark, sf), ["pair_id"], "context")
    return found.select("pair_id", F.col("idx").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\n[ \t\x0B\f\r]*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''))::BIGINT AS n_paragraphs FROM documents")
def paragraphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))


@query(f"""WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'context')} SELECT substr({plain_sql('text')}, 1, 4) AS stem, count(*)::BIGINT AS n, count(DISTINCT pair_id)::BIGINT AS pairs FROM tok WHERE {content_sql('text')} GROUP BY 1""")
def stems(spark, sf):
    toks = pairs(spark, sf).select("pair_id", F.explode(tx.token_array(F.col("context"))).alias("text")).where(tx.is_content(F.col("text")))
    return toks.groupBy(tx.stem(F.col("text")).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pair_id").alias("pairs"))


@query(f"""WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')}, w AS (SELECT DISTINCT '^' || {plain_sql('text')} || '$' AS p FROM tok WHERE {plain_sql('text')} <> ''),
    g AS (SELECT DISTINCT p, substr(p, i, 3) AS gram FROM w, range(1, 200) t(i) WHERE i <= greatest(1, length(p) - 2)) SELECT gram, count(*)::BIGINT AS words FROM g GROUP BY gram""")
def trigrams(spark, sf):
    words = pairs(spark, sf).select(F.explode(tx.token_array(F.col("answer"))).alias("t")).select(tx.plain(F.col("t")).alias("w")).where("w <> ''").distinct()
    return words.select(F.explode(tx.grams(F.col("w"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("words"))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 2.7))::INT END AS tokens FROM documents")
def estimated_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')}, w AS (SELECT pair_id, idx, translate(lower(trim(text, {BLANKS})), 'ё', 'е') AS w FROM tok),
    n AS (SELECT pair_id, idx, w, lead(w) OVER o AS w2, row_number() OVER (PARTITION BY pair_id, w ORDER BY idx) AS seen FROM w WINDOW o AS (PARTITION BY pair_id ORDER BY idx))
    SELECT w || ' ' || w2 AS bigram, count(*)::BIGINT AS n, count(*) FILTER (seen > 1)::BIGINT AS repeats FROM n WHERE w2 IS NOT NULL GROUP BY 1""")
def bigram_counts(spark, sf):
    toks = tx.tokens(pairs(spark, sf), ["pair_id"], "answer").withColumn("w", F.translate(F.lower(F.btrim(F.col("text"), F.lit(tx.BLANKS))), "ё", "е"))
    rows = toks.withColumn("w2", F.lead("w").over(W.partitionBy("pair_id").orderBy("idx"))).withColumn("seen", F.row_number().over(W.partitionBy("pair_id", "w").orderBy("idx")))
    return rows.where("w2 is not null").groupBy(F.concat_ws(" ", "w", "w2").alias("bigram")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seen") > 1).alias("repeats"))


# ---- features and verdicts

_VOCAB = f"""{PAIRS}, {tokens_sql('ta', 'pairs', 'pair_id', 'answer')}, {tokens_sql('tc', 'pairs', 'pair_id', 'context')},
    va AS (SELECT pair_id, {plain_sql('text')} AS word, count(*) AS n FROM ta WHERE {content_sql('text')} GROUP BY 1, 2),
    vc AS (SELECT pair_id, {plain_sql('text')} AS word, count(*) AS n FROM tc WHERE {content_sql('text')} GROUP BY 1, 2),
    grams AS (SELECT word, list_distinct([substr('^' || word || '$', i, 3) for i in range(1, greatest(2, length(word) + 1))]) AS gs FROM (SELECT word FROM va UNION SELECT word FROM vc) WHERE word <> ''),
    ga AS (SELECT pair_id, va.word, len(gs) AS na, unnest(gs) AS gram FROM va JOIN grams USING (word)),
    gc AS (SELECT pair_id, vc.word AS other, n, len(gs) AS nc, unnest(gs) AS gram FROM vc JOIN grams USING (word)),
    sim AS (SELECT pair_id, word, other, n, count(*) / (na + nc - count(*)) AS j FROM ga JOIN gc USING (pair_id, gram) GROUP BY pair_id, word, other, n, na, nc),
    ranked AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pair_id, word ORDER BY j DESC, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sim),
    total AS (SELECT pair_id, sum(n) AS words FROM vc GROUP BY pair_id),
    near AS (SELECT pair_id, word, max(j) AS max_sim, sum(greatest(0, least(n, 5 - before)) * j) / any_value(greatest(1, least(5, words))) AS top_mean FROM ranked JOIN total USING (pair_id) GROUP BY pair_id, word),
    sup AS (SELECT va.pair_id, va.word, CASE WHEN EXISTS (SELECT 1 FROM vc WHERE vc.pair_id = va.pair_id AND substr(vc.word, 1, 4) = substr(va.word, 1, 4)) THEN 1.0 ELSE 0.7 * coalesce(max_sim, 0) END AS support,
        coalesce(max_sim, 0) AS max_sim, coalesce(top_mean, 0) AS top_mean FROM va LEFT JOIN near USING (pair_id, word))"""


@query(f"WITH {_VOCAB} SELECT pair_id, word, round(support, 6)::DOUBLE AS support, round(max_sim, 6)::DOUBLE AS max_sim, round(top_mean, 6)::DOUBLE AS top_mean FROM sup")
def lexical_support(spark, sf):
    p = pairs(spark, sf)
    asked, known = ft.vocabulary(p, "answer"), ft.vocabulary(p, "context")
    out = ft.supports(asked, known, ft.similarities(asked, known))
    return out.select("pair_id", "word", *(F.round(c, 6).alias(c) for c in ("support", "max_sim", "top_mean")))


@query(f"WITH {_VOCAB} SELECT pair_id, word FROM va WHERE NOT EXISTS (SELECT 1 FROM vc WHERE vc.pair_id = va.pair_id AND substr(vc.word, 1, 4) = substr(va.word, 1, 4))")
def unsupported_words(spark, sf):
    p = pairs(spark, sf)
    return spans.unsupported(ft.vocabulary(p, "answer"), ft.vocabulary(p, "context"), ["pair_id", "stem"]).select("pair_id", "word")


_NUMBERS = f"""numbered AS (SELECT pair_id, idx, {number_sql('text')} AS own, {plain_sql('text')} AS word FROM ta),
    started AS (SELECT *, CASE WHEN own IS NOT NULL AND lag(own) OVER (PARTITION BY pair_id ORDER BY idx) IS NULL THEN 1 ELSE 0 END AS fresh FROM numbered),
    runs AS (SELECT pair_id, idx, word, sum(fresh) OVER (PARTITION BY pair_id ORDER BY idx) AS run FROM started WHERE own IS NOT NULL),
    groups AS (SELECT pair_id, min(idx) AS first, count(*) AS n, CASE WHEN bool_and(regexp_matches(word, '^[0-9]+$')) THEN regexp_replace(string_agg(word, '' ORDER BY idx), '^0+([0-9])', '\\1') END AS value FROM runs GROUP BY pair_id, run)"""


@query(f"WITH {tokens_sql('ta', '(SELECT doc_id AS pair_id, text AS context FROM documents)', 'pair_id', 'context')}, {_NUMBERS} SELECT pair_id, first::BIGINT AS first, n::BIGINT AS n, value FROM groups")
def number_groups(spark, sf):
    """Runs of numbers in documents; the tables hold digits only, number words are tested apart."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), "text")
    toks = ft.number_groups(tx.tokens(docs, ["pair_id"], "text"))
    own = tx.number_value(tx.edge_word(F.col("text"))).isNotNull()
    runs = sequence.islands(toks.where(own), "pair_id", "idx")
    return runs.groupBy("pair_id", "island").agg(F.min("idx").cast("long").alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("value").alias("value")).drop("island")


_FEATURES = f"""{_VOCAB},
    t AS (SELECT pair_id, idx, text, start, "end", {plain_sql('text')} AS word, {content_sql('text')} AS content, {scored_sql('text')} AS scored FROM ta),
    f0 AS (SELECT t.*, CASE WHEN content THEN coalesce(support, 0) ELSE 0 END AS mass, CASE WHEN content THEN least(1, coalesce(max_sim, 0)) ELSE 0 END AS max_sim,
        CASE WHEN content THEN least(1, coalesce(top_mean, 0) / {lex.DENSITY_REFERENCE}) ELSE 0 END AS density,
        CASE WHEN row_number() OVER (PARTITION BY t.pair_id, t.word ORDER BY idx) > 1 THEN 0.2 ELSE 0 END::DOUBLE AS entropy FROM t LEFT JOIN sup USING (pair_id, word)),
    f1 AS (SELECT *, avg(CASE WHEN content THEN mass END) OVER (PARTITION BY pair_id) AS mean_mass, max(entropy) OVER (PARTITION BY pair_id) AS top FROM f0),
    f2 AS (SELECT *, least(1, CASE WHEN content THEN mass / greatest(mean_mass, 1e-9) ELSE mass END) AS mass_norm, CASE WHEN top > 1e-12 THEN entropy / top ELSE 0 END AS scaled FROM f1),
    risky AS (SELECT *, greatest(0, least(1, 0.1::DOUBLE * scaled + 0.4::DOUBLE * (1 - mass) + 0.2::DOUBLE * (1 - mass_norm) + 0.2::DOUBLE * (1 - max_sim) + 0.1::DOUBLE * (1 - density))) AS risk FROM f2),
    zeroed AS (SELECT *, CASE WHEN scored THEN risk ELSE 0 END AS base FROM risky),
    sided AS (SELECT *, lag(base) OVER o AS l, lead(base) OVER o AS r, count(*) OVER (PARTITION BY pair_id) AS n FROM zeroed WINDOW o AS (PARTITION BY pair_id ORDER BY idx)),
    smooth AS (SELECT *, round(CASE WHEN n < 3 THEN base ELSE (0.6::DOUBLE * base + 0.2::DOUBLE * coalesce(l, 0) + 0.2::DOUBLE * coalesce(r, 0)) / (0.6::DOUBLE + CASE WHEN l IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN r IS NULL THEN 0 ELSE 0.2::DOUBLE END) END, 12) AS s FROM sided),
    mid AS (SELECT pair_id, median(s) AS m, count(*) AS n_scored FROM smooth WHERE scored GROUP BY pair_id),
    lim AS (SELECT pair_id, any_value(n_scored) AS n_scored, round(greatest(0, least(0.6::DOUBLE, greatest(any_value(m) + 1.4826::DOUBLE * median(abs(s - m)), 0.35::DOUBLE))), 12) AS span_threshold FROM smooth JOIN mid USING (pair_id) WHERE scored GROUP BY pair_id),
    flagged AS (SELECT s.pair_id, idx, text, start, "end", s, idx - row_number() OVER (PARTITION BY s.pair_id ORDER BY idx) AS isle FROM smooth s JOIN lim USING (pair_id) WHERE scored AND s >= span_threshold),
    spans AS (SELECT pair_id, min(start) AS start, max("end") - (length(arg_max(text, idx)) - length(rtrim(arg_max(text, idx), {BLANKS}))) AS stop, max(s) AS risk, count(*) AS n_tokens FROM flagged GROUP BY pair_id, isle),
    answers AS (SELECT pair_id, list_sort(list(s) FILTER (scored), 'DESC') AS v, count(*) AS n_tokens FROM smooth GROUP BY pair_id),
    scores AS (SELECT pair_id, n_tokens, CASE WHEN len(coalesce(v, [])) > 0 THEN 0.5 * list_avg(v) + 0.5 * list_avg(v[1:greatest(1, floor(len(v) * 0.2::DOUBLE + 1e-9)::INT)]) ELSE 0 END AS score FROM answers)"""


@query(f"WITH {_FEATURES} SELECT pair_id, idx::BIGINT AS idx, scored, round(entropy, 6)::DOUBLE AS entropy, round(mass, 6)::DOUBLE AS mass, round(mass_norm, 6)::DOUBLE AS mass_norm, round(max_sim, 6)::DOUBLE AS max_sim, round(density, 6)::DOUBLE AS density FROM risky")
def token_features(spark, sf):
    rows = ft.token_features(pairs(spark, sf))
    return rows.select("pair_id", F.col("idx").cast("long"), "scored", *(F.round(c, 6).alias(c) for c in lex.WEIGHTS))


@query(f"WITH {_FEATURES} SELECT pair_id, idx::BIGINT AS idx, round(risk, 6)::DOUBLE AS risk, round(s, 6)::DOUBLE AS smooth FROM smooth")
def token_risk(spark, sf):
    return vf.token_risks(pairs(spark, sf)).select("pair_id", F.col("idx").cast("long"), F.round("risk", 6).alias("risk"), F.round("smooth", 6).alias("smooth"))


@query(f"WITH {_FEATURES} SELECT pair_id, n_scored::BIGINT AS n_scored, round(span_threshold, 6)::DOUBLE AS span_threshold FROM lim")
def span_thresholds(spark, sf):
    return vf.thresholds(vf.token_risks(pairs(spark, sf))).select("pair_id", "n_scored", F.round("span_threshold", 6).alias("span_threshold"))


@query(f'WITH {_FEATURES} SELECT pair_id, start::BIGINT AS start, stop::BIGINT AS "end", round(risk, 6)::DOUBLE AS risk, n_tokens::BIGINT AS n_tokens FROM spans')
def mask_islands(spark, sf):
    out = vf.mask_spans(vf.spanned(vf.token_risks(pairs(spark, sf))))
    return out.select("pair_id", F.col("start").cast("long"), F.col("end").cast("long"), F.round("risk", 6).alias("risk"), "n_tokens")


@query(f"""WITH {_FEATURES}, held AS (SELECT pair_id, count(*) AS n_spans, sum(n_tokens) AS mask_tokens, max(stop - start) AS longest FROM spans GROUP BY pair_id)
    SELECT p.pair_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_scored, 0)::BIGINT AS n_scored, round(coalesce(score, 0), 6)::DOUBLE AS score, coalesce(n_spans, 0)::BIGINT AS n_spans,
        round(CASE WHEN n_scored > 0 THEN coalesce(mask_tokens, 0) / n_scored ELSE 0 END, 6)::DOUBLE AS ai_share_hard,
        CASE WHEN coalesce(n_tokens, 0) = 0 THEN 'empty' WHEN round(score, 9) >= 0.5 THEN 'likely_hallucination' WHEN mask_tokens >= 2 AND longest >= 20 THEN 'doubtful' ELSE 'grounded' END AS verdict
    FROM pairs p LEFT JOIN scores USING (pair_id) LEFT JOIN lim USING (pair_id) LEFT JOIN held USING (pair_id)""")
def verdicts(spark, sf):
    """The flagship: every assistant turn judged against the user turn before it."""
    out = vf.verify(pairs(spark, sf))
    return out.select("pair_id", "n_tokens", "n_scored", F.round("score", 6).alias("score"), "n_spans", F.round("ai_share_hard", 6).alias("ai_share_hard"), "verdict")


@query(rf"""WITH {_FEATURES}, kept AS (SELECT pair_id, idx, s, sum(CASE WHEN scored AND s < 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY idx) AS lows, scored FROM smooth),
    grown AS (SELECT pair_id, idx, s, CASE WHEN idx - lag(idx) OVER o > 2 OR lows <> lag(lows) OVER o THEN 1 ELSE 0 END AS fresh FROM kept WHERE scored AND s >= 0.3 WINDOW o AS (PARTITION BY pair_id ORDER BY idx)),
    parts AS (SELECT *, sum(fresh) OVER (PARTITION BY pair_id ORDER BY idx) AS c FROM grown)
    SELECT pair_id, min(idx)::BIGINT AS first, max(idx)::BIGINT AS last, count(*)::BIGINT AS n FROM parts GROUP BY pair_id, c HAVING count(*) FILTER (s >= 0.6) >= 1""")
def hysteresis_components(spark, sf):
    kept = sequence.hysteresis(vf.token_risks(pairs(spark, sf)), "pair_id", "idx", "smooth", "scored", low=0.3, high=0.6, bridge=1, least=1)
    return kept.groupBy("pair_id", "component").agg(F.min("idx").cast("long").alias("first"), F.max("idx").cast("long").alias("last"), F.count(F.lit(1)).alias("n")).drop("component")


@query(f"""WITH {_FEATURES}, z AS (SELECT pair_id, idx, s FROM smooth WHERE scored), n AS (SELECT pair_id, idx, s, coalesce(lag(s) OVER o, first_value(s) OVER w) AS p1, coalesce(lag(s, 2) OVER o, first_value(s) OVER w) AS p2, coalesce(lead(s) OVER o, last_value(s) OVER w) AS n1, coalesce(lead(s, 2) OVER o, last_value(s) OVER w) AS n2
    FROM z WINDOW o AS (PARTITION BY pair_id ORDER BY idx), w AS (PARTITION BY pair_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT pair_id, idx::BIGINT AS idx, round(p1, 6) AS smooth_previous_1, round(n2, 6) AS smooth_next_2, round(greatest(p1, p2), 6) AS smooth_left_max, round((p1 + p2 + n1 + n2) / 4, 6) AS smooth_mean, round(s - (p1 + p2 + n1 + n2) / 4, 6) + 0.0 AS smooth_minus_mean FROM n""")
def context_features(spark, sf):
    rows = sequence.neighbour_features(vf.token_risks(pairs(spark, sf)).where("scored"), "pair_id", "idx", ["smooth"], 2)
    return rows.select("pair_id", F.col("idx").cast("long"), *((F.round(f"smooth_{c}", 6) + 0.0).alias(f"smooth_{c}") for c in ("previous_1", "next_2", "left_max", "mean", "minus_mean")))


_STATS = ("entropy", "mass", "mass_norm", "max_sim", "density")


@query(f"WITH {_FEATURES} SELECT pair_id, count(*)::BIGINT AS n, " + ", ".join(f"round(avg({c}), 6)::DOUBLE AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 6)::DOUBLE AS {c}_std, round(min({c}), 6)::DOUBLE AS {c}_min, round(quantile_cont({c}::DOUBLE, 0.1), 6)::DOUBLE AS {c}_q10, round(median({c}::DOUBLE), 6)::DOUBLE AS {c}_median, round(quantile_cont({c}::DOUBLE, 0.9), 6)::DOUBLE AS {c}_q90, round(max({c}), 6)::DOUBLE AS {c}_max" for c in _STATS) + ", round(ln(1 + count(*)), 6) AS log_n FROM risky WHERE scored GROUP BY pair_id")
def answer_summary(spark, sf):
    rows = ft.token_features(pairs(spark, sf)).where("scored")
    stats = {"mean": F.avg, "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)), "min": F.min, "q10": lambda c: F.percentile(c, F.lit(0.1)), "median": F.median, "q90": lambda c: F.percentile(c, F.lit(0.9)), "max": F.max}
    return rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), *(F.round(f(c), 6).alias(f"{c}_{n}") for c in _STATS for n, f in stats.items()), F.round(F.log1p(F.count(F.lit(1))), 6).alias("log_n"))


# ---- sequences over events

_EV = "ev AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))


@query(f"WITH {_EV} SELECT user_id, pos::BIGINT AS pos, round(CASE WHEN count(*) OVER (PARTITION BY user_id) < 3 THEN value ELSE avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END, 6) AS mean FROM ev")
def moving_average(spark, sf):
    return sequence.moving_average(_events(spark, sf), "user_id", "pos", "value", 7, "mean").select("user_id", F.col("pos").cast("long"), F.round("mean", 6).alias("mean"))


@query(f"WITH {_EV}, x AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN value END AS v FROM ev) SELECT user_id, pos::BIGINT AS pos, round(coalesce(v, avg(v) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), value), 6) AS filled FROM x")
def impute_uninformative(spark, sf):
    rows = sequence.imputed(_events(spark, sf), "user_id", "pos", "value", F.col("event_type").isin("click", "view"), 2, "filled")
    return rows.select("user_id", F.col("pos").cast("long"), F.round("filled", 6).alias("filled"))


@query(f"""WITH {_EV}, s AS (SELECT user_id, pos * 10 AS start, pos * 10 + (event_id % 17) AS stop FROM ev), b AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    r AS (SELECT *, sum(CASE WHEN start <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT user_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS "end", count(*)::BIGINT AS parts FROM r GROUP BY user_id, run""")
def interval_merge(spark, sf):
    rows = _events(spark, sf).select("user_id", (F.col("pos") * 10).cast("long").alias("start"), (F.col("pos") * 10 + F.col("event_id") % 17).cast("long").alias("end"))
    return sequence.merged(rows, ["user_id"], join_gap=1)


# ---- metrics over document scores


@query(f"WITH {SCORED}, c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.6) AS tp, count(*) FILTER (label = 0 AND score >= 0.6) AS fp, count(*) FILTER (label = 1 AND score < 0.6) AS fn, count(*) FILTER (label = 0 AND score < 0.6) AS tn FROM scored) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, CASE WHEN 2 * tp / (2 * tp + fp + fn) >= 0.5 AND fp / (fp + tn) <= 0.4 THEN 'reached' ELSE 'not reached' END AS gate FROM c")
def confusion(spark, sf):
    out = metrics.gate(metrics.confusion(scored_docs(spark, sf), F.col("label"), F.col("score") >= 0.6), 0.5, 0.4)
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr", "accuracy")), "gate")


@query(f"""WITH {SCORED}, r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM scored),
    a AS (SELECT lang, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n, sum(r) FILTER (label = 1) AS s FROM r GROUP BY lang) SELECT lang, p::BIGINT AS n_pos, n::BIGINT AS n_neg, round(CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2) / (p * n) END, 6)::DOUBLE AS auc FROM a""")
def auc_by_language(spark, sf):
    return metrics.auc(scored_docs(spark, sf), "score", "label", ["lang"]).withColumn("auc", F.round("auc", 6))


@query(f"WITH {SCORED} SELECT count(*)::BIGINT AS n, round(avg((score - label) * (score - label)), 6) AS brier FROM scored")
def brier(spark, sf):
    return metrics.brier(scored_docs(spark, sf), "score", "label").withColumn("brier", F.round("brier", 6))


@query(f"WITH {SCORED}, b AS (SELECT least(9, floor(score * 10)) AS bin, count(*) AS n, avg(score) AS s, avg(label) AS w FROM scored GROUP BY 1) SELECT round(sum(n * abs(s - w)) / sum(n), 6) AS ece, count(*)::BIGINT AS bins FROM b")
def calibration_error(spark, sf):
    return metrics.calibration_error(scored_docs(spark, sf), "score", "label").withColumn("ece", F.round("ece", 6))


_CURVE = f"""{SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY score),
    c AS (SELECT score AS threshold, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g),
    curve AS (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, (n - fp)::BIGINT AS tn, 2 * tp / (tp + fp + p) AS f1, fp / n AS fpr FROM c)"""


@query(f"WITH {_CURVE} SELECT threshold, tp, fp, fn, tn, round(f1, 6)::DOUBLE AS f1, round(fpr, 6)::DOUBLE AS fpr FROM curve")
def threshold_curve(spark, sf):
    return metrics.threshold_curve(scored_docs(spark, sf), "score", "label").withColumns({c: rounded(F.col(c), 6) for c in ("f1", "fpr")})


@query(f"WITH {_CURVE} SELECT threshold, tp, fp, fn, tn, round(f1, 6)::DOUBLE AS f1, round(fpr, 6)::DOUBLE AS fpr, fpr <= 0.3 AS constraint_met FROM curve ORDER BY constraint_met DESC, round(f1, 12) DESC, fpr, threshold DESC LIMIT 1")
def best_threshold(spark, sf):
    return metrics.best_threshold(scored_docs(spark, sf), "score", "label", 0.3).withColumns({c: rounded(F.col(c), 6) for c in ("f1", "fpr")})


@query(f"""WITH {SCORED}, g AS (SELECT round(score, 1) AS x, sum(label) AS y, count(*) AS n FROM scored GROUP BY 1),
    m AS (SELECT a.x AS lo, b.x AS hi, sum(c.y) / sum(c.n) AS v FROM g a JOIN g b ON a.x <= b.x JOIN g c ON c.x BETWEEN a.x AND b.x GROUP BY 1, 2),
    k AS (SELECT t.x, m.lo, min(m.v) AS v FROM g t JOIN m ON m.lo <= t.x AND m.hi >= t.x GROUP BY 1, 2) SELECT x, round(max(v), 6) AS calibrated FROM k GROUP BY x""")
def isotonic(spark, sf):
    rows = scored_docs(spark, sf)
    steps = calibration.isotonic(rows, "score", "label", digits=1)
    return rows.select(F.round("score", 1).alias("x")).distinct().select("x", F.round(steps.column(F.col("x")), 6).alias("calibrated"))


@query()
def bootstrap_interval(spark, sf):
    out = metrics.bootstrap_auc(scored_docs(spark, sf), "score", "label", "source")
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


# ---- texts against each other

_ROUGE = """{p}, a AS (SELECT pair_id, substr(context, i, {n}) AS g, count(*) AS c FROM pairs, range(1, 4000) t(i) WHERE i <= length(context) - {m} GROUP BY 1, 2), b AS (SELECT pair_id, substr(answer, i, {n}) AS g, count(*) AS c FROM pairs, range(1, 40000) t(i) WHERE i <= length(answer) - {m} GROUP BY 1, 2),
    x AS (SELECT pair_id, sum(least(a.c, b.c)) AS shared FROM a JOIN b USING (pair_id, g) GROUP BY 1), y AS (SELECT p.pair_id, coalesce(shared, 0) AS shared, greatest(0, length(context) - {m}) AS na, greatest(0, length(answer) - {m}) AS nb FROM pairs p LEFT JOIN x USING (pair_id))
    SELECT pair_id, round(CASE WHEN na + nb > 0 THEN 2 * shared / (na + nb) ELSE 0 END, 6)::DOUBLE AS rouge FROM y"""


@query("WITH " + _ROUGE.format(p=PAIRS, n=1, m=0))
def rouge_1(spark, sf):
    return metrics.rouge_n(pairs(spark, sf), "pair_id", "context", "answer", 1).withColumn("rouge", F.round("rouge", 6))


@query("WITH " + _ROUGE.format(p=PAIRS, n=2, m=1))
def rouge_2(spark, sf):
    return metrics.rouge_n(pairs(spark, sf), "pair_id", "context", "answer", 2).withColumn("rouge", F.round("rouge", 6))


@query()
def rouge_l(spark, sf):
    rouge = F.pandas_udf(metrics.rouge_l, "double")
    return pairs(spark, sf).select("pair_id", F.round(rouge("context", "answer"), 6).alias("rouge"))


@query("""WITH RECURSIVE p AS (SELECT n_nationkey, r_regionkey, n_name AS a, r_name AS b FROM nation, region),
    d AS (SELECT n_nationkey, r_regionkey, 0 AS i, list_transform(range(1, length(b) + 1), lambda x: 0) AS held FROM p UNION ALL
        SELECT d.n_nationkey, d.r_regionkey, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(held[k], CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN CASE WHEN k > 1 THEN held[k - 1] ELSE 0 END + 1 ELSE 0 END)))) FROM d JOIN p USING (n_nationkey, r_regionkey) WHERE i < length(a))
    SELECT n_nationkey, r_regionkey, round(2 * held[length(b)] / (length(a) + length(b)), 6)::DOUBLE AS rouge FROM d JOIN p USING (n_nationkey, r_regionkey) WHERE i = length(a)""")
def rouge_l_names(spark, sf):
    """The names of nations and regions."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").join(table(spark, sf, "region").select("r_regionkey", "r_name"), F.lit(True))
    return rows.select("n_nationkey", "r_regionkey", F.round(F.pandas_udf(metrics.rouge_l, "double")("n_name", "r_name"), 6).alias("rouge"))


@query(f"""WITH {PAIRS}, w AS (SELECT list_distinct(regexp_extract_all(lower(context), '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}]+')) AS b FROM pairs),
    j AS (SELECT len(list_intersect(a, b)) AS shared, len(a) + len(b) - len(list_intersect(a, b)) AS every FROM w), k AS (SELECT CASE WHEN every = 0 THEN 1 ELSE shared / every END AS s, CASE WHEN shared = every THEN 1 ELSE 0 END AS e FROM j)
    SELECT count(*)::BIGINT AS n, round(avg(e), 6)::DOUBLE AS accuracy, round(avg(s), 6)::DOUBLE AS jaccard, round(avg(1 - s), 6)::DOUBLE AS hamming FROM k""")
def set_match(spark, sf):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    out = metrics.set_match(pairs(spark, sf).select(words("context").alias("a"), words("answer").alias("b")), "b", "a")
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "jaccard", "hamming")})


_SENT = f"s0 AS (SELECT pair_id, list_filter({SENTENCES.format('answer')}, lambda x: trim(x, {BLANKS}) <> '') AS ss FROM pairs), s1 AS (SELECT pair_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS passage FROM s0)"
_TERMS = "list_filter(regexp_extract_all(lower(coalesce({}, '')), '[а-яёa-z0-9]+'), lambda x: length(x) > 1)"


@query(f"""WITH {PAIRS}, {_SENT}, d AS (SELECT pair_id, passage, {_TERMS.format('text')} AS ts FROM s1), tf AS (SELECT pair_id, passage, t AS term, count(*) AS tf FROM (SELECT pair_id, passage, unnest(ts) AS t FROM d) GROUP BY 1, 2, 3),
    df AS (SELECT pair_id, term, count(*) AS df FROM tf GROUP BY 1, 2), st AS (SELECT pair_id, count(*) AS n, avg(len(ts)) AS mean FROM d GROUP BY 1), q AS (SELECT DISTINCT pair_id, unnest({_TERMS.format('context')}) AS term FROM pairs),
    sc AS (SELECT pair_id, passage, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / mean))) AS score FROM q JOIN tf USING (pair_id, term) JOIN df USING (pair_id, term) JOIN d USING (pair_id, passage) JOIN st USING (pair_id) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(score, 9) DESC, passage) AS rank FROM sc) SELECT pair_id, passage::BIGINT AS passage, round(score, 5)::DOUBLE AS score, rank::BIGINT AS rank FROM r WHERE rank <= 3""")
def bm25_top3(spark, sf):
    """The answer's sentences ranked for the question."""
    p = pairs(spark, sf)
    found = F.filter(tx.sentence_array(F.col("answer")), lambda x: F.btrim(x, F.lit(tx.BLANKS)) != "")
    passages = p.select("pair_id", F.posexplode(found).alias("passage", "text"))
    top = retrieval.top_passages(retrieval.bm25(p.select("pair_id", F.col("context").alias("query")), passages, "pair_id"), "pair_id")
    return top.select("pair_id", F.col("passage").cast("long"), F.round("score", 5).alias("score"), F.col("rank").cast("long"))


_MOST = int(lex.CHUNK_TOKENS * lex.CHARS_PER_TOKEN)


@query(f"""WITH RECURSIVE s0 AS (SELECT doc_id, {SENTENCES.format('text')} AS ss FROM documents), s AS (SELECT doc_id, ss, len(ss) AS n, list_transform(range(1, len(ss) + 1), lambda i: list_sum(list_transform(ss[1:i], lambda x: length(x)))) AS cum FROM s0),
    r AS (SELECT doc_id, 0 AS chunk, 0 AS a, greatest(1, len(list_filter(cum, lambda c: c <= {_MOST}))) AS b FROM s UNION ALL
        SELECT doc_id, chunk + 1, greatest(a + 1, b - {lex.CHUNK_OVERLAP}), greatest(greatest(a + 1, b - {lex.CHUNK_OVERLAP}) + 1, len(list_filter(cum, lambda c: c - cum[greatest(a + 1, b - {lex.CHUNK_OVERLAP})] <= {_MOST}))) FROM r JOIN s USING (doc_id) WHERE b < n)
    SELECT doc_id, chunk::BIGINT AS chunk, CASE WHEN a = 0 THEN 0 ELSE cum[a] END::BIGINT AS start, cum[b]::BIGINT AS "end", sha256(array_to_string(ss[a + 1:b], '')) AS sha FROM r JOIN s USING (doc_id)""")
def chunk_documents(spark, sf):
    out = retrieval.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("chunk").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), F.sha2("text", 256).alias("sha"))


_LABELLED = f"""{PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')}, sp AS (SELECT pair_id, idx * 7 AS start, idx * 7 + 3 AS stop FROM tok WHERE idx % 5 = 0)"""


@query(f"""WITH {_LABELLED} SELECT pair_id, count(*)::BIGINT AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM sp WHERE sp.pair_id = tok.pair_id AND tok.start < sp.stop AND tok."end" > sp.start) THEN 1 ELSE 0 END)::BIGINT AS labelled FROM tok GROUP BY pair_id""")
def span_labels(spark, sf):
    """Tokens that overlap marked spans (three characters at every 35th)."""
    toks = tx.tokens(pairs(spark, sf), ["pair_id"], "answer")
    marked = toks.where("idx % 5 = 0").select("pair_id", (F.col("idx") * 7).alias("start"), (F.col("idx") * 7 + 3).alias("end"))
    return spans.labelled(toks, marked, "pair_id").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("labelled"))


@query()
def span_f1(spark, sf):
    toks = tx.tokens(pairs(spark, sf), ["pair_id"], "answer")
    said = toks.where("idx % 4 = 0").select("pair_id", "start", "end")
    gold = toks.where("idx % 6 = 0").select("pair_id", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"))
    return metrics.span_f1(said, gold, "pair_id").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# ---- splits, counts, vectors, pages


@query("SELECT doc_id, CAST(('0x' || substr(sha256('42:' || source), 1, 8))::BIGINT % 5 AS INT) AS fold FROM documents")
def folds(spark, sf):
    return splits.folds(table(spark, sf, "documents"), F.col("source"), 5).select("doc_id", "fold")


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, sf):
    return splits.sample(table(spark, sf, "documents"), "doc_id", 100).select("doc_id")


@query("SELECT item_id, CAST((row_number() OVER (ORDER BY sha256('42:' || item_id), item_id) - 1) % 16 AS INT) AS slot FROM benchmark")
def round_robin(spark, sf):
    return splits.round_robin(table(spark, sf, "benchmark"), "item_id", 16).select("item_id", "slot")


_SPLIT = "c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), u AS (SELECT source, (sum(n) OVER (ORDER BY sha256('42:' || source), source) - n) / sum(n) OVER () AS share FROM c), sp AS (SELECT source, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.85 THEN 'dev' ELSE 'test' END AS split FROM u)"


@query(f"WITH {_SPLIT} SELECT split, count(*)::BIGINT AS docs, count(DISTINCT d.source)::BIGINT AS groups FROM documents d JOIN sp USING (source) GROUP BY split")
def group_split(spark, sf):
    rows = splits.ratio_split(table(spark, sf, "documents"), "source", {"train": 0.7, "dev": 0.15, "test": 0.15})
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("groups"))


@query("SELECT text, count(DISTINCT source)::BIGINT AS splits FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def shared_texts(spark, sf):
    return splits.shared_groups(table(spark, sf, "documents"), "text", "source")


@query("SELECT conv_id, max(turn)::BIGINT AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def last_turns(spark, sf):
    from plumbline.sources.pairs import last_of

    return last_of(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", F.col("turn").cast("long"), "role")


@query("SELECT lang, source, grouping_id(lang, source)::BIGINT AS level, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def corpus_totals(spark, sf):
    table(spark, sf, "documents").select("lang", "source", F.length("text").alias("chars")).createOrReplaceTempView("plumbline_totals")
    return spark.sql("SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS docs, sum(chars) AS chars FROM plumbline_totals GROUP BY GROUPING SETS ((lang), (source), ())").select("lang", "source", F.col("level").cast("long"), "docs", F.col("chars").cast("long"))


@query(r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents), v AS (SELECT lang, count(*) AS words, count(DISTINCT word) AS vocabulary FROM w GROUP BY lang)
    SELECT lang, count(*)::BIGINT AS docs, round(avg(length(text)), 6)::DOUBLE AS mean_chars, any_value(words)::BIGINT AS words, any_value(vocabulary)::BIGINT AS vocabulary FROM documents JOIN v USING (lang) GROUP BY lang""")
def corpus_stats(spark, sf):
    docs = table(spark, sf, "documents")
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = words.groupBy("lang").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("vocabulary"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(F.length("text")), 6).alias("mean_chars")).join(words, "lang")


_KNN = """q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(q.e, r.e), 9) AS c FROM q JOIN r ON q.vec_id <> r.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)"""


@query(f"WITH {_KNN} SELECT query_id, vec_id, round(c, 6)::DOUBLE AS cosine, rank::BIGINT AS rank FROM k WHERE rank <= 5")
def nearest_vectors(spark, sf):
    """Queries are the rows whose id is divisible by 100, searched in all rows."""
    rows = table(spark, sf, "embeddings")
    out = vectors.nearest(rows.where("vec_id % 100 = 0"), rows, 5)
    return out.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long"))


@query(f"WITH {_KNN} SELECT query_id, round(avg(c), 6)::DOUBLE AS density FROM k WHERE rank <= 5 GROUP BY query_id")
def knn_density(spark, sf):
    rows = table(spark, sf, "embeddings")
    return vectors.density(vectors.nearest(rows.where("vec_id % 100 = 0"), rows, 5)).withColumn("density", F.round("density", 6))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.stripped_tags(F.col("html")).alias("text"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]+)"', 1))::BIGINT AS n_links, len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))::BIGINT AS n_distinct FROM pages""")
def page_links(spark, sf):
    found = tx.links(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages""")
def visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.visible(F.col("html")).alias("text"))


# ---- rules, detector, heads


_NUM = r"list_transform(regexp_extract_all(coalesce({}, ''), '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.'))"


_NEIGHBOURS = "pairs AS (SELECT a.doc_id AS pair_id, a.text AS context, b.text AS answer FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def neighbours(spark, sf):
    """Every document as the context of the next one."""
    docs = table(spark, sf, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("answer"))
    return docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("context")).join(after, "pair_id")


@query(f"WITH {_NEIGHBOURS}, s AS (SELECT pair_id, unnest({_NUM.format('answer')}) AS value FROM pairs), c AS (SELECT DISTINCT pair_id, unnest({_NUM.format('context')}) AS value FROM pairs) SELECT pair_id, value, count(*)::BIGINT AS n FROM s ANTI JOIN c USING (pair_id, value) GROUP BY ALL")
def missing_numbers(spark, sf):
    return rules.missing_numbers(neighbours(spark, sf))


@query()
def weight_grid(spark, sf):
    """AUC of the weight grid's cells for telling whether a token's word occurs in the context."""
    rows = ft.token_features(pairs(spark, sf)).where("scored").withColumn("label", (F.col("mass") < 1).cast("int"))
    return heads.grid_auc(rows, "label", ["entropy", "max_sim", "density"], step=5).withColumn("auc", F.round("auc", 6))


@query(f"""WITH {PAIRS}, {_SENT}, d AS (SELECT pair_id, passage, {_TERMS.format('text')} AS ts FROM s1), tf AS (SELECT pair_id, passage, t AS term, count(*) AS tf FROM (SELECT pair_id, passage, unnest(ts) AS t FROM d) GROUP BY 1, 2, 3),
    df AS (SELECT pair_id, term, count(*) AS df FROM tf GROUP BY 1, 2), st AS (SELECT pair_id, count(*) AS n, avg(len(ts)) AS mean FROM d GROUP BY 1), q AS (SELECT DISTINCT pair_id, unnest({_TERMS.format('context')}) AS term FROM pairs),
    sc AS (SELECT pair_id, passage, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / mean))) AS score FROM q JOIN tf USING (pair_id, term) JOIN df USING (pair_id, term) JOIN d USING (pair_id, passage) JOIN st USING (pair_id) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(score, 9) DESC, passage) AS rank FROM sc), g AS (SELECT pair_id, arg_max(passage, (length(text), -passage)) AS passage FROM s1 GROUP BY pair_id)
    SELECT k::BIGINT AS k, count(*)::BIGINT AS n, round(avg(CASE WHEN rank <= k THEN 1 ELSE 0 END), 6)::DOUBLE AS recall FROM g LEFT JOIN r USING (pair_id, passage), (VALUES (1), (3), (5)) t(k) GROUP BY k""")
def recall_at_k(spark, sf):
    """How often the longest sentence of the answer is among the first k for the question."""
    p = pairs(spark, sf)
    found = F.filter(tx.sentence_array(F.col("answer")), lambda x: F.btrim(x, F.lit(tx.BLANKS)) != "")
    passages = p.select("pair_id", F.posexplode(found).alias("passage", "text"))
    gold = passages.groupBy("pair_id").agg(F.max_by("passage", F.struct(F.length("text"), -F.col("passage"))).alias("passage"))
    top = retrieval.top_passages(retrieval.bm25(p.select("pair_id", F.col("context").alias("query")), passages, "pair_id"), "pair_id", 5)
    return retrieval.recall(top, gold, "pair_id").select(F.col("k").cast("long"), "n", F.round("recall", 6).alias("recall"))


# ---- corpora


@query("SELECT lang, count(*)::BIGINT AS n, " + ", ".join(f"round(quantile_cont(length(text)::DOUBLE, {p}), 6) AS \"{n}\"" for n, p in corpus.POINTS.items()) + " FROM documents GROUP BY lang")
def length_distribution(spark, sf):
    out = corpus.distribution(table(spark, sf, "documents"), F.length("text"), ["lang"])
    return out.select("lang", "n", *(F.round(c, 6).alias(c) for c in corpus.POINTS))


@query("SELECT m AS mode, count(e.event_id)::BIGINT AS n, round(count(e.event_id) / (SELECT count(*) FROM events), 6) AS share, count(e.event_id) >= 100 AS enough FROM (VALUES ('click'), ('view'), ('purchase'), ('never')) t(m) LEFT JOIN events e ON e.event_type = m GROUP BY m")
def mode_balance(spark, sf):
    return corpus.balance(table(spark, sf, "events"), "event_type", ["click", "view", "purchase", "never"], 100).withColumn("share", F.round("share", 6))


@query("SELECT page_id, NOT (starts_with(p, '/en/1') OR starts_with(p, '/de/')) AS allowed FROM (SELECT page_id, CASE WHEN regexp_replace(url, '^[a-z]+://[^/]*', '') = '' THEN '/' ELSE regexp_replace(url, '^[a-z]+://[^/]*', '') END AS p FROM pages)")
def crawl_rules(spark, sf):
    return table(spark, sf, "pages").select("page_id", corpus.allowed(F.col("url"), ["/en/1", "", "/de/"]).alias("allowed"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licence' WHEN regexp_matches(text, '[%$&*]{3}') THEN 'symbols' WHEN regexp_matches(text, ' [|] ') THEN 'table' END AS theme FROM documents")
def themes(spark, sf):
    rules_ = {"licence": "(?i)licen[cs]e", "symbols": "[%$&*]{3}", "table": " [|] "}
    return table(spark, sf, "documents").select("doc_id", corpus.first_match(F.col("text"), rules_).alias("theme"))


@query(r"""SELECT doc_id, trim(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(173), ''), chr(160), ' '), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n\n+', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)), ' ' || chr(10)) AS text FROM documents""")
def tidy_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", corpus.tidy(F.col("text")).alias("text"))


@query(f"WITH {PAIRS} SELECT pair_id, sha256('demo||512|' || answer || '|' || context) AS key FROM pairs")
def cache_keys(spark, sf):
    return pairs(spark, sf).select("pair_id", corpus.cache_key(F.lit("demo"), F.lit(""), 512, F.col("answer"), F.col("context")).alias("key"))


@query("SELECT conv_id, ['a', 'b', 'c', 'd', 'e'][1 + ('0x' || substr(sha256('42:' || conv_id), 1, 8))::BIGINT % 5] AS template FROM (SELECT DISTINCT conv_id FROM conversations)")
def template_choice(spark, sf):
    return table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", corpus.choice(list("abcde"), F.concat(F.lit("42:"), F.col("conv_id").cast("string"))).alias("template"))


@query("SELECT conv_id, round(avg(length(text)) FILTER (role = 'assistant') - avg(length(text)) FILTER (role = 'user'), 6)::DOUBLE AS difference FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0 AND count(*) FILTER (role = 'user') > 0")
def paired_lengths(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("chars", F.length("text"))
    return corpus.paired_difference(rows, "conv_id", "role", "chars", "assistant", "user").withColumn("difference", F.round("difference", 6))


@query(f"WITH {PAIRS}, w AS (SELECT pair_id, context, answer, regexp_extract(answer, '[\\p{{L}}]{{2,}}') AS part FROM pairs) SELECT pair_id, CASE WHEN part <> '' AND strpos(context, part) > 0 THEN strpos(context, part) - 1 END::BIGINT AS place, CASE WHEN part <> '' THEN (length(context) - length(replace(context, part, ''))) / length(part) ELSE 0 END::BIGINT AS times FROM w")
def quoted_words(spark, sf):
    """Where the answer's first word of two letters or more stands in the context."""
    rows = pairs(spark, sf).withColumn("part", F.regexp_extract("answer", r"[\p{L}]{2,}", 0))
    return corpus.quoted_at(rows, "context", "part").select("pair_id", F.col("place").cast("long"), F.col("times").cast("long"))


@query("WITH said AS (SELECT pair_id, idx, start, \"end\" FROM tok WHERE idx % 4 = 0), gold AS (SELECT pair_id, start + 1 AS start, \"end\" + 1 AS stop FROM tok WHERE idx % 6 = 0) SELECT count(*)::BIGINT AS n FROM said WHERE EXISTS (SELECT 1 FROM gold WHERE gold.pair_id = said.pair_id AND said.start < gold.stop AND said.\"end\" > gold.start)".replace("WITH said", f"WITH {PAIRS}, {tokens_sql('tok', 'pairs', 'pair_id', 'answer')}, said"))
def overlapping_spans(spark, sf):
    toks = tx.tokens(pairs(spark, sf), ["pair_id"], "answer")
    gold = toks.where("idx % 6 = 0").select("pair_id", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"))
    return spans.overlapping(toks.where("idx % 4 = 0"), gold, "pair_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS priority, count(*)::BIGINT AS n, " + ", ".join(f"round(quantile_cont(o_totalprice::DOUBLE, {p}), 2) AS \"{n}\"" for n, p in corpus.POINTS.items()) + " FROM orders GROUP BY 1")
def price_distribution(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority")
    out = corpus.distribution(rows, F.col("o_totalprice"), ["priority"])
    return out.select("priority", "n", *(F.round(c, 2).alias(c) for c in corpus.POINTS))
