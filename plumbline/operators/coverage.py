"""How answers deal with the facts of their contexts: sentences with a value, its subject and condition, and what an answer says of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import normalize as nm
from plumbline.functions import text as tx

#: Kinds of values that say least; another value of the sentence is preferred.
PLAIN_KINDS = ("count", "single_number")
ANY_VALUE = "|".join(f"(?:{p})" for p in lex.VALUE_PATTERNS.values())
#: What a value can start with.
STARTS = r"(?iU)[\dА-Яа-яЁё]"
#: A value, a run of what starts none, or one more character: together the whole text.
PIECE = rf"{ANY_VALUE}|[^0-9А-Яа-яЁё]+|[\s\S]"


def kind_of(piece: Column) -> Column:
    """The first kind of value that a piece is; null if it is none."""
    tests = [(k, piece.rlike(f"(?iU)^(?:{p})$")) for k, p in lex.VALUE_PATTERNS.items()]
    return reduce(lambda out, t: out.when(t[1], t[0]), tests[1:], F.when(tests[0][1], tests[0][0]))


def values(text: Column) -> Column:
    """Array of (at, text, kind): the values of a text in order, none inside another; at is the offset."""
    pieces = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iU)({PIECE})"), F.lit(1)), lambda p: F.struct(p.alias("text"), F.when(p.rlike("[0-9]") | (F.length(p) > 3), kind_of(p)).alias("kind")))
    row = "array<struct<at:int,text:string,kind:string>>"
    state = lambda at, found: F.struct(at.cast("int").alias("at"), found.cast(row).alias("found"))

    def step(a: Column, p: Column) -> Column:
        own = F.array(F.struct(a["at"].alias("at"), F.btrim(p["text"], F.lit(tx.BLANKS)).alias("text"), p["kind"].alias("kind")))
        return state(a["at"] + F.length(p["text"]), F.when(p["kind"].isNotNull(), F.concat(a["found"], own)).otherwise(a["found"]))

    return F.aggregate(pieces, state(F.lit(0), F.array()), step, lambda a: a["found"])


def subject(sentence: Column, at: Column, most: int = 4) -> Column:
    """Up to `most` significant words before an offset, lower-case."""
    words = F.transform(F.regexp_extract_all(F.left(sentence, at), F.lit("([А-Яа-яЁёA-Za-z]+)"), F.lit(1)), F.lower)
    words = F.filter(words, lambda w: ~w.isin(lex.NO_SUBJECT) & (F.length(w) >= 3))
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - most + 1), most), " ")


def condition(sentence: Column) -> Column:
    """From the first marker of a condition to the next comma; '' without one."""
    places = F.filter(F.array(*(F.position(F.lit(m), F.lower(sentence)) for m in lex.CONDITIONS)), lambda p: p > 0)
    first = F.array_min(places)
    return F.coalesce(F.btrim(F.substring_index(F.substring(sentence, first, F.length(sentence)), ",", 1), F.lit(" ,.;:")), F.lit(""))


def facts(pairs: DataFrame, least_words: int = 5, most: int | None = 60) -> DataFrame:
    """(pair_id, sentence, text, start, value, value_start, kind, subject, condition): context sentences of enough words that hold a value.

    The first `most` of a pair; None for all."""
    # Only sentences that can hold a value, of which the first character is one of STARTS, leave their text.
    wanted = lambda s: s.rlike(STARTS) & (F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")) >= least_words)
    rows = pairs.select("pair_id", F.explode(tx.chosen(tx.sentence_array(F.col("context")), wanted)).alias("s")).select("pair_id", F.col("s.idx").alias("sentence"), F.col("s.text").alias("text"), F.col("s.start").alias("start"))
    rows = rows.withColumn("v", F.explode(F.array(values(F.col("text"))))).withColumnRenamed("v", "values").where(F.size("values") > 0)
    telling = F.filter("values", lambda v: ~v["kind"].isin(*PLAIN_KINDS))
    rows = rows.withColumn("v", F.when(F.size(telling) > 0, telling[0]).otherwise(F.col("values")[0]))
    out = rows.select("pair_id", "sentence", "text", "start", F.col("v.text").alias("value"), (F.col("start") + F.col("v.at")).alias("value_start"), F.col("v.kind").alias("kind"), subject(F.col("text"), F.col("v.at")).alias("subject"), condition(F.col("text")).alias("condition"))
    if most is None:
        return out
    # The first ones of a pair by their sentence, an array of at most `most` rows.
    names = out.columns[1:]
    held = out.groupBy("pair_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(*names))), 1, most).alias("rows"))
    return held.select("pair_id", F.explode("rows").alias("r")).select("pair_id", "r.*")


def share_of(stems: Column, pool: Column) -> Column:
    """The share of stems (with repeats) that a pool holds; 0 without any."""
    return F.when(F.size(stems) > 0, F.size(F.filter(stems, lambda s: F.array_contains(pool, s))) / F.size(stems)).otherwise(0.0)


def places_of_subject(low: Column, name: Column) -> Column:
    """Array of (at, n): the words of a subject that are in a lower-cased answer, at from 1 on."""
    words = F.filter(F.regexp_extract_all(F.lower(name), F.lit("([А-Яа-яЁёA-Za-z]+)"), F.lit(1)), lambda w: F.length(w) > 2)
    return F.filter(F.transform(words, lambda w: F.struct(F.call_function("locate", w, low).alias("at"), F.length(w).alias("n"))), lambda p: p["at"] > 0)


def coverage(pairs: DataFrame, *, omit: float = 0.55, whole_subject: float = 1.0, near_subject: float = 0.8, most: int | None = None) -> DataFrame:
    """facts() with overlap, status, and where in the answer (answer_start, answer_end, subject_start, subject_end; -1 if nowhere).

    mentioned: the answer has the value; partial: it has, but less than half of the
    condition; omitted: it tells the sentence with its whole subject and no value;
    distorted: with another value, or with most of the subject; irrelevant: none of it.
    Pairs without an answer or context have no rows; with `most`, only the first facts of a pair have."""
    spoken = tx.chosen(tx.sentence_array(F.col("answer")), lambda s: F.btrim(s, F.lit(tx.BLANKS)) != "")
    said = F.transform(spoken, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end"), s["text"].alias("text"), F.array_distinct(nm.stems_of(s["text"])).alias("pool")))
    # A pair's facts meet its answer as one row, so that only answers to contexts with facts are cut and normalised, once each.
    found = facts(pairs, most=most)
    names = found.columns[1:]
    held = found.groupBy("pair_id").agg(F.collect_list(F.struct(*names)).alias("facts"))
    rows = held.join(pairs.where("answer <> ''").select("pair_id", "answer"), "pair_id").withColumn("normal", nm.for_match(F.col("answer")))
    # The explode keeps what is made of an answer from being made again for each fact; facts stay within the row till they need no more of it, as a row for each would hold a copy.
    whole = F.struct("normal", F.array_distinct(F.split("normal", " ")).alias("words"), F.lower("answer").alias("low"), said.alias("said"))
    rows = rows.select("pair_id", "facts", F.length("answer").alias("length"), F.explode(F.array(whole)).alias("a"))
    fields = [*names]

    def told(**more) -> None:
        nonlocal rows
        old = tuple(fields)
        rows = rows.withColumn("facts", F.transform("facts", lambda f: F.struct(*(f[c].alias(c) for c in old), *(make(f).alias(c) for c, make in more.items()))))
        fields.extend(more)

    a = F.col("a")
    shared = lambda f: F.array_max(F.transform(a["said"], lambda s, i: F.struct(F.size(F.filter(f["stems"], lambda w: F.array_contains(s["pool"], w))).alias("n"), (-i).alias("order"))))
    told(stems=lambda f: nm.stems_of(f["text"]), norm_value=lambda f: nm.for_match(f["value"]), of_subject=lambda f: nm.stems_of(f["subject"]), of_condition=lambda f: nm.stems_of(f["condition"]))
    told(top=shared, own=lambda f: share_of(f["of_subject"], a["words"]), held=lambda f: share_of(f["of_condition"], a["words"]), present=lambda f: (f["norm_value"] != "") & F.contains(a["normal"], f["norm_value"]))
    told(overlap=lambda f: F.when(F.size(f["stems"]) > 0, F.coalesce(f["top"]["n"], F.lit(0)) / F.size(f["stems"])).otherwise(0.0), best=lambda f: F.get(a["said"], -f["top"]["order"]))
    near = lambda f: f["present"] | ((f["own"] >= min(whole_subject, near_subject)) & (f["overlap"] >= omit))
    told(places=lambda f: F.when(near(f), places_of_subject(a["low"], f["subject"])))
    kept = ("norm_value", "of_subject", "overlap", "own", "held", "present", "places")
    rows = rows.select("pair_id", "length", F.explode(F.transform("facts", lambda f: F.struct(*(f[c].alias(c) for c in (*names, *kept)), F.struct(*(f["best"][c].alias(c) for c in ("start", "end", "text"))).alias("best")))).alias("f")).select("pair_id", "length", "f.*")
    rows = rows.withColumn("others", values(F.col("best.text")))
    same = F.filter("others", lambda v: v["kind"] == F.col("kind"))
    other = F.exists(F.when(F.size(same) > 0, same).otherwise(F.col("others")), lambda v: nm.for_match(v["text"]) != F.col("norm_value"))
    status = F.when(F.col("present"), F.when((F.col("condition") != "") & (F.col("held") < 0.5), "partial").otherwise("mentioned"))
    status = status.when((F.col("own") >= whole_subject) & (F.col("overlap") >= omit), F.when(F.coalesce(other, F.lit(False)), "distorted").otherwise("omitted"))
    status = status.when((F.col("own") >= near_subject) & (F.col("overlap") >= omit), "distorted").otherwise("irrelevant")
    rows = rows.withColumn("status", status)
    nowhere = (F.col("status") == "irrelevant") | ((F.col("status") == "mentioned") & (F.size("of_subject") == 0))
    found = F.col("overlap") > 0
    first = F.coalesce(F.array_min(F.transform("places", lambda p: p["at"] - 1)), F.lit(-1))
    last = F.coalesce(F.array_max(F.transform("places", lambda p: p["at"] - 1 + p["n"])), F.lit(-1))
    away = F.col("status") == "irrelevant"
    return rows.select(
        "pair_id", "sentence", "text", "start", "value", "value_start", "kind", "subject", "condition", F.round("overlap", 4).alias("overlap"), "status",
        F.when(nowhere, -1).when(found, F.col("best.start")).otherwise(0).alias("answer_start"), F.when(nowhere, -1).when(found, F.col("best.end")).otherwise(F.col("length")).alias("answer_end"),
        F.when(away, -1).otherwise(first).alias("subject_start"), F.when(away, -1).otherwise(last).alias("subject_end"),
    )


def missing(covered: DataFrame) -> DataFrame:
    return covered.where("status = 'omitted'")


def partial(covered: DataFrame) -> DataFrame:
    return covered.where("status = 'partial'")
