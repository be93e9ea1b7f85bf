"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The token budget goes down a tree of domain, language and source. At each node it is
dealt to the children by weight; a child that can't use its part (its tokens times
`epochs`) takes what it can, and the rest goes to its siblings by weight, so a
shortage leaves a node for its ancestors only when all siblings are full. Each leaf
then takes whole epochs and a token-prefix of one more, in an order drawn from the
seed, the epoch and the doc_id.

The prefix of a leaf is found without sorting the leaf in one task: documents fall
into buckets by their drawn key, bucket sums are accumulated, and only the bucket in
which the budget ends is ordered document by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, fresh, sized, word_count, written

#: Target weights; domains by the last digit of the source's name, a stand-in for a table of sites.
DOMAINS = {"web": 0.5, "books": 0.3, "code": 0.15, "other": 0.05}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
OTHER_LANGUAGE = 0.05
#: Documents that a bucket holds on average; buckets of a leaf at most.
IN_BUCKET, MOST_BUCKETS = 400, 1 << 20


def domain_of(source: Column) -> Column:
    digit = F.regexp_extract(F.coalesce(source, F.lit("")), "[0-9]$", 0)
    return F.when(digit == "", "other").when(digit <= "4", "web").when(digit <= "7", "books").otherwise("code")


def weight_of(name: Column, weights: dict[str, float], other: float) -> Column:
    return reduce(lambda out, x: out.when(name == x[0], F.lit(x[1])), list(weights.items())[1:], F.when(name == list(weights)[0], F.lit(weights[list(weights)[0]]))).otherwise(F.lit(other)).cast("double")


def dealt(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (parent..., weight, capacity, budget of the parent) with `part`, the child's part of the budget.

    In order of capacity per weight the full children come first, so whether one is
    full follows from running sums; the others share what is left by weight. Children
    alike in that ratio are summed before they are ordered, so however many children a
    node has, one task orders no more than their distinct ratios."""
    x = children.where("weight > 0 and capacity > 0").withColumn("ratio", F.col("capacity") / F.col("weight"))
    levels = x.groupBy(*parent, "ratio").agg(F.sum("capacity").alias("caps"), F.sum("weight").alias("weights"), F.first("budget").alias("budget"))
    before = W.partitionBy(*parent).orderBy("ratio").rowsBetween(W.unboundedPreceding, -1)
    first = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    full = F.col("ratio") * (F.sum("weights").over(W.partitionBy(*parent)) - first("weights")) <= F.col("budget") - first("caps")
    levels = levels.withColumn("is_full", full)
    filled, rest = F.col("is_full"), ~F.col("is_full")
    levels = levels.groupBy(*parent).agg(F.max(F.when(filled, F.col("ratio"))).alias("level"), F.coalesce(F.sum(F.when(filled, F.col("caps"))), F.lit(0.0)).alias("used"), F.sum(F.when(rest, F.col("weights"))).alias("open"))
    x = x.join(levels, parent)
    part = F.when(F.col("ratio") <= F.col("level"), F.col("capacity")).otherwise(F.col("weight") * (F.col("budget") - F.col("used")) / F.col("open"))
    return x.withColumn("part", part).drop("ratio", "level", "used", "open")


def budgets(leaves: DataFrame, *, fraction: float, epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `part`, the tokens that each is to give (double)."""
    caps = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast("double"))
    root = caps.agg((F.floor(F.sum("tokens") * fraction)).cast("double").alias("budget"))
    top = caps.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(F.col("domain"), DOMAINS, 0.0))
    top = dealt(top.join(F.broadcast(root)).withColumn("root", F.lit(1)), ["root"]).select("domain", F.col("part").alias("budget"))
    mid = caps.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(F.col("lang"), LANGUAGES, OTHER_LANGUAGE))
    mid = dealt(mid.join(top, "domain"), ["domain"]).select("domain", "lang", F.col("part").alias("budget"))
    low = caps.withColumn("weight", F.lit(1.0))
    return dealt(low.join(mid, ["domain", "lang"]), ["domain", "lang"]).select("domain", "lang", "source", "n_docs", "tokens", "part")


def drawn(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The key that orders documents within an epoch: 16 hex digits."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))), 1, 16)


LEAF = ["domain", "lang", "source"]
LOWEST = -(1 << 63)


def leaf_columns(documents: DataFrame) -> list[Column]:
    """domain, lang and source of a document; '' for null."""
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("lang", "source"))
    return [domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source")]


def prefixes(own: DataFrame, *, fraction: float, epochs: int, seed: int) -> DataFrame:
    """What each leaf of own (doc_id, domain, lang, source, n_tokens) gives: LEAF, whole epochs, and where the prefix of one more ends.

    The end is a bucket of drawn keys and, in it, the last key and id taken (null: none); without a bucket, nothing ends it."""
    leaves = own.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    plan = budgets(leaves, fraction=fraction, epochs=epochs)
    plan = plan.withColumn("part", F.floor(F.col("part") + 1e-6)).withColumn("whole", F.floor(F.col("part") / F.col("tokens")).cast("int"))
    plan = plan.withColumn("rest", F.col("part") - F.col("whole") * F.col("tokens"))
    plan = plan.withColumn("buckets", F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("n_docs") / IN_BUCKET)).cast("long"))
    plan = written(plan.select(*LEAF, "whole", "rest", "buckets"), "plan")

    met = written(placed(own, plan, seed).select("doc_id", *LEAF, "n_tokens", "key", "bucket"), "drawn")
    sums = met.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("tokens")).join(sized(plan, row_bytes()), LEAF)
    sums = sums.withColumn("until", F.sum("tokens").over(W.partitionBy(*LEAF).orderBy("bucket")))
    cut = sums.where("until > rest").groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("until") + F.col("tokens")).alias("left"))).alias("cut"))
    cut = written(cut.select(*LEAF, F.col("cut.bucket").alias("cut"), F.col("cut.left").alias("left")), "cut")

    # Rows alike in key and id are peers of the running sum: they come together or not at all.
    last = met.join(sized(cut, row_bytes()), LEAF).where("bucket = cut").withColumn("id", F.coalesce("doc_id", F.lit(LOWEST)))
    last = last.withColumn("running", F.sum("n_tokens").over(W.partitionBy(*LEAF).orderBy("key", "id"))).where("running <= left")
    last = last.groupBy(*LEAF).agg(F.max(F.struct("key", "id")).alias("last"))
    out = plan.join(cut.drop("left"), LEAF, "left").join(last, LEAF, "left")
    out = written(out.select(*LEAF, "whole", "buckets", "cut", F.col("last.key").alias("last_key"), F.col("last.id").alias("last_id")), "prefixes")
    for used in (plan, met, cut):
        dropped(used)
    return out


def row_bytes() -> Column:
    """Width of a row about a leaf."""
    return reduce(lambda n, c: n + F.octet_length(c), LEAF, F.lit(96))


def placed(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id and LEAF) of leaves in plan, with what plan says and the key and bucket in the epoch after the whole ones."""
    met = rows.join(sized(plan, row_bytes()), LEAF)
    met = met.withColumn("key", drawn(seed, F.col("whole"), F.col("doc_id")))
    return met.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets"), 32))


def taken(rows: DataFrame, plan: DataFrame, *, epochs: int, seed: int) -> DataFrame:
    """rows (doc_id, LEAF, more) with `epoch`, once for each time that they are taken."""
    met = placed(rows, plan, seed)
    key, end = F.col("key"), F.col("last_key")
    until = (key < end) | ((key == end) & (F.coalesce("doc_id", F.lit(LOWEST)) <= F.col("last_id")))
    inside = F.col("cut").isNull() | (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & F.coalesce(until, F.lit(False)))
    times = F.col("whole") + F.when(inside & (F.col("whole") < epochs), 1).otherwise(0)
    each = F.when(times > 0, F.sequence(F.lit(0).cast("long"), (times - 1).cast("long")))
    return met.select(*rows.columns, F.explode(each).alias("epoch"))


def mixed_sources(documents: DataFrame, *, fraction: float = 0.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens): a row for each time that a document is taken.

    The budget is `fraction` of the corpus's tokens (words); no leaf repeats its
    documents more than `epochs` times. A prefix holds the documents whose running sum
    of tokens stays within the leaf's remaining budget. Null lang or source: a node
    named ''. Null, empty or blank texts have no tokens and come with the prefix that
    they stand in; a leaf without any tokens gives nothing, nor does an empty table.
    Null doc_id: the empty id. Equal keys are ordered by doc_id; repeated rows are rows
    of their own, and those that share an id come into a prefix together or not at all.
    Extra columns are not read."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text").cast("string")).alias("n_tokens"), *leaf_columns(documents))
    own = written(own, "tokens")
    return taken(own, prefixes(own, fraction=fraction, epochs=epochs, seed=seed), epochs=epochs, seed=seed).select("doc_id", *LEAF, "epoch", "n_tokens")


def mixed_documents(documents: DataFrame, *, fraction: float = 0.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """documents with all their columns, then domain, epoch and n_tokens, a row for each time that one is taken, as in mixed_sources.

    Texts are neither joined nor shuffled: the ends of the prefixes are, one row for a
    leaf. A column of documents that has a new one's name keeps it; the new one gets a
    trailing underscore."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text").cast("string")).alias("n_tokens"), *leaf_columns(documents))
    own = written(own, "tokens")
    plan = prefixes(own, fraction=fraction, epochs=epochs, seed=seed)
    dropped(own)
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text").cast("string")).alias("n_tokens"), *leaf_columns(documents), whole)
    name = fresh(documents)
    more = [F.col(c).alias(name(c)) for c in ("domain", "epoch", "n_tokens")]
    return taken(rows, plan, epochs=epochs, seed=seed).select(*(F.col("row").getField(c).alias(c) for c in documents.columns), *more)


def mixing_sql(fraction: float = 0.5, epochs: int = 2, seed: int = 17, documents: str = "documents") -> str:
    """DuckDB SQL for the query over documents."""

    def deal(children: str, parent: str, child: str) -> str:
        over, until = f"OVER (PARTITION BY {parent})", f"OVER (PARTITION BY {parent} ORDER BY capacity / weight, {child} ROWS UNBOUNDED PRECEDING)"
        return f"""(SELECT *, CASE WHEN is_full THEN capacity ELSE weight * (budget - used) / open END AS part FROM (
            SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) {over} AS used, sum(CASE WHEN is_full THEN 0 ELSE weight END) {over} AS open FROM (
            SELECT *, capacity * (every - weights + weight) <= weight * (budget - caps + capacity) AS is_full FROM (
            SELECT *, sum(capacity) {until} AS caps, sum(weight) {until} AS weights, sum(weight) {over} AS every FROM {children} WHERE weight > 0 AND capacity > 0))))"""

    case = lambda name, weights, other: "CAST(CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END AS DOUBLE)"
    return f"""
    WITH own AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
                        CASE WHEN NOT regexp_matches(coalesce(source, ''), '[0-9]$') THEN 'other' WHEN right(source, 1) <= '4' THEN 'web' WHEN right(source, 1) <= '7' THEN 'books' ELSE 'code' END AS domain FROM {documents}),
    leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) * {epochs} AS DOUBLE) AS capacity, 1.0::DOUBLE AS weight FROM own GROUP BY ALL),
    top0 AS (SELECT domain, sum(capacity) AS capacity, {case('domain', DOMAINS, 0.0)} AS weight, 1 AS root, (SELECT CAST(floor(sum(tokens) * {fraction}) AS DOUBLE) FROM leaves) AS budget FROM leaves GROUP BY domain),
    top AS (SELECT domain, part AS budget FROM {deal('top0', 'root', 'domain')}),
    mid0 AS (SELECT l.domain, lang, sum(capacity) AS capacity, {case('lang', LANGUAGES, OTHER_LANGUAGE)} AS weight, any_value(budget) AS budget FROM leaves l JOIN top USING (domain) GROUP BY l.domain, lang),
    mid AS (SELECT domain, lang, part AS budget FROM {deal('mid0', 'domain', 'lang')}),
    low0 AS (SELECT l.*, m.budget FROM leaves l JOIN mid m USING (domain, lang)),
    plan AS (SELECT domain, lang, source, CAST(floor(floor(part + 1e-6) / tokens) AS INT) AS whole, CAST(floor(part + 1e-6) - floor(floor(part + 1e-6) / tokens) * tokens AS BIGINT) AS rest FROM {deal('low0', 'domain, lang', 'source')}),
    met AS (SELECT o.*, whole, rest FROM own o JOIN plan USING (domain, lang, source)),
    ordered AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(md5('{seed}:' || whole || ':' || doc_id), 1, 16), doc_id) AS running FROM met)
    SELECT doc_id, domain, lang, source, CAST(e AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens FROM (SELECT *, unnest(range(whole)) AS e FROM met)
    UNION ALL SELECT doc_id, domain, lang, source, CAST(whole AS BIGINT), CAST(n_tokens AS BIGINT) FROM ordered WHERE running <= rest AND whole < {epochs}
    """
