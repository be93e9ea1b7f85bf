"""Answers made from the facts of documents: faithful ones, and ones with a known mistake and its place."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import corpus

MODES = ("faithful", "value", "omission", "condition", "invention")
INVENTED = " Кроме того, предусмотрена надбавка в размере 15 процентов."


def changed_value(value: Column) -> Column:
    """A value whose first number is doubled and one more; null if it has none."""
    digits = F.regexp_extract(value, "[0-9]+", 0)
    return F.when(digits != "", F.regexp_replace(value, F.lit("[0-9]+"), (2 * digits.cast("long") + 1).cast("string")))


def variant(mode: str) -> Column:
    """(answer, start, end) made of a fact's columns text, value, at (of the value in the text) and condition; null where the mode doesn't apply."""
    text, value, at = F.col("text"), F.col("value"), F.col("at")
    empty = F.lit(None).cast("int")
    row = lambda a, s, e: F.struct(a.alias("answer"), s.cast("int").alias("start"), e.cast("int").alias("end"))
    head, tail = F.left(text, at), F.substring(text, at + F.length(value) + 1, F.length(text))
    if mode == "faithful":
        return row(text, empty, empty)
    if mode == "value":
        new = F.regexp_extract(changed_value(value), r"^[\s\S]*$", 0)
        return F.when(changed_value(value).isNotNull(), row(F.concat(head, new, tail), at, at + F.length(new)))
    if mode == "omission":
        return row(F.concat(F.rtrim(head), tail), F.length(F.rtrim(head)), F.length(F.rtrim(head)) + F.length(tail))
    if mode == "condition":
        cut = F.position(F.col("condition"), text)
        kept = F.rtrim(F.left(text, F.greatest(F.lit(0), cut - 1)), F.lit(" ,;"))
        return F.when((F.col("condition") != "") & (cut > 1), row(F.concat(kept, F.lit(".")), F.lit(0), F.length(kept) + 1))
    if mode == "invention":
        return row(F.concat(F.rtrim(text), F.lit(INVENTED)), F.length(F.rtrim(text)) + 1, F.length(F.rtrim(text)) + len(INVENTED))
    raise ValueError(f"unknown mode: {mode!r}")


def made_pairs(facts: DataFrame, modes: tuple[str, ...] = MODES, seed: str = "42") -> DataFrame:
    """(id, context, answer, start, end, mode, digest) for facts (doc_id, sentence, text, value, at, condition, context): one mode for each, chosen by hash; faithful where it doesn't apply."""
    mode = corpus.choice(list(modes), F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("sentence").cast("string")))
    made = F.coalesce(*(F.when(F.col("mode") == m, variant(m)) for m in modes))
    rows = facts.withColumn("mode", mode).withColumn("v", made).withColumn("mode", F.when(F.col("v").isNull(), "faithful").otherwise(F.col("mode"))).withColumn("v", F.coalesce("v", variant("faithful")))
    name = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("sentence").cast("string"))
    return rows.select(name.alias("id"), "context", F.col("v.answer").alias("answer"), F.col("v.start").alias("start"), F.col("v.end").alias("end"), "mode", pair_digest(F.col("context"), F.col("v.answer")).alias("digest"))


def pair_digest(context: Column, answer: Column) -> Column:
    """A pair's SHA-256."""
    return F.sha2(F.concat(context, F.lit("\n"), answer), 256)


def question(subject: Column) -> Column:
    return F.concat(F.lit("Что сказано в документе о том, что такое "), subject, F.lit("?"))


def prompt(context: Column, asked: Column) -> Column:
    """What a model is asked: the document, then the question."""
    return F.concat(F.lit("Документ:\n"), context, F.lit("\n\nВопрос: "), asked, F.lit("\nОтветь только по документу."))


def unit_form(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a unit that goes with a number."""
    last, tens = F.abs(n) % 10, F.abs(n) % 100
    return F.when(tens.between(11, 14), many).when(last == 1, one).when(last.between(2, 4), few).otherwise(many)


def unused(rows: DataFrame, pool: list[str], key: str, seed: str = "42") -> DataFrame:
    """rows with pick: each its own one of the pool in hash order, over again when the pool is used up.

    Positions come from counts of hash buckets and ranks within them, so no task orders all rows."""
    from plumbline.operators.splits import ranked

    order = sorted(pool, key=lambda p: sha256(f"{seed}:{p}".encode()).hexdigest())
    return ranked(rows, key, seed).withColumn("pick", F.get(F.array(*map(F.lit, order)), (F.col("rank") % len(order)).cast("int"))).drop("rank")


def full_sentence(answer: Column, start: Column, end: Column) -> Column:
    """(start, end) of the sentences of an answer that a span touches."""
    sizes = F.transform(tx.sentence_array(answer), F.length)
    ends = F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b))
    both = F.zip_with(ends, sizes, lambda e, n: F.struct((e - n).alias("a"), e.alias("b")))
    met = F.filter(both, lambda s: (s["a"] < end) & (s["b"] > start))
    return F.struct(F.coalesce(F.array_min(F.transform(met, lambda s: s["a"])), start).alias("start"), F.coalesce(F.array_max(F.transform(met, lambda s: s["b"])), end).alias("end"))


def subject_prefix(text: Column, at: Column) -> Column:
    """What stands before a value, without blanks and signs at its end."""
    return F.rtrim(F.left(text, at), F.lit(" ,.;:—-"))
