"""Rule labels: citations and numbers of an answer that its act lacks or contradicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import normalize as nm
from plumbline.functions import text as tx

NUMBER = r"\d+(?:[.,]\d+)*"
#: A citation, a number with its unit, a run of what starts neither, or one more character.
PIECE = rf"(?:{lex.CITATION_WORDS})\s*(?:№\s*)?\d+(?:[.\-]\d+)*|(?<!\w){NUMBER}(?:\s*(?:{lex.ATOM_UNITS}))?|[^0-9А-Яа-яЁё]+|[\s\S]"
ATOM = "doc_id string, start int, end int, kind string, text string, value string, unit string, is_range boolean"


def near_words(text: Column, start: Column, end: Column, reach: int = 90) -> Column:
    """Distinct words of three letters or more within reach of text[start:end], stop words left out."""
    left = F.substring(text, F.greatest(F.lit(0), start - reach) + 1, F.least(start, F.lit(reach)))
    right = F.substring(text, end + 1, F.lit(reach))
    words = F.regexp_extract_all(F.lower(F.concat(left, F.lit(" "), right)), F.lit("([а-яёa-z]{3,})"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(lex.ATOM_STOP_WORDS)))


def atoms(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, start, end, kind, text, value, unit, is_range, near): citations and numbers of a text."""
    held = rows.select(F.col(key).alias("k"), F.col(column).alias("whole"), F.explode(tx.located(F.col(column), f"(?iU){PIECE}", lambda p: p.rlike("[0-9]"))).alias("p"))
    found = held.select("k", "whole", "p.text", F.col("p.at").alias("start"), (F.col("p.at") + F.length("p.text")).alias("end"))
    before = F.substring("whole", F.col("start"), F.lit(1))
    found = found.where(~F.col("text").rlike("^[0-9]") | (F.col("start") == 0) | ~before.rlike(r"(?U)^\w$"))
    number = F.col("text").rlike("^[0-9]")
    digits = F.when(number, F.regexp_extract("text", f"^{NUMBER}", 0)).otherwise(F.regexp_extract("text", r"\d+(?:[.\-]\d+)*$", 0))
    ranged = number & F.substring("whole", F.col("end") + 1, F.lit(3)).rlike(r"(?U)^\s*[-—–]\s*\d")
    unit = F.when(number, F.btrim(F.substring("text", F.length(digits) + 1, F.length("text")), F.lit(tx.BLANKS))).otherwise("")
    near = near_words(F.col("whole"), F.col("start"), F.col("end"))
    return found.select(F.col("k").alias(key), "start", "end", F.when(number, "number").otherwise("citation").alias("kind"), "text", nm.plain_value(digits).alias("value"), unit.alias("unit"), ranged.alias("is_range"), near.alias("near"), nm.unclear_near(F.col("whole"), F.col("start"), F.col("end")).alias("hedged"))


def act_numbers(acts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, value, near) of every number of an act, as it stands, citations' numbers included."""
    pieces = tx.located(F.col(column), rf"(?U)(?<!\w){NUMBER}|[^0-9]+|[\s\S]", lambda p: p.rlike("^[0-9]"))
    found = acts.select(F.col(key).alias("k"), F.col(column).alias("whole"), F.explode(pieces).alias("p"))
    found = found.select("k", "whole", "p.text", F.col("p.at").alias("start"), (F.col("p.at") + F.length("p.text")).alias("end"))
    before = F.substring("whole", F.col("start"), F.lit(1))
    found = found.where((F.col("start") == 0) | ~before.rlike(r"(?U)^\w$"))
    value = nm.plain_value(F.col("text"))
    return found.select(F.col("k").alias(key), value.alias("value"), near_words(F.col("whole"), F.col("start"), F.col("end")).alias("near")).where("value <> '' and length(value) <= 24")


def labelled(answers: DataFrame, acts: DataFrame, mode: str = "any_window", alike: float = 0.6) -> DataFrame:
    """atoms of answers (answer_id, doc_id, answer) with rule: a for a number that the act (doc_id, text) lacks, b for a citation, c for another number in like words, unclear, or null.

    Words around an atom and around the act's numbers are compared by their Jaccard
    similarity; any_window takes any number that is alike enough, best_window only the
    most alike. They meet through shared words, so nothing is paired that shares none."""
    said = atoms(answers, "answer_id", "answer").join(answers.select("answer_id", "doc_id"), "answer_id")
    numbers = act_numbers(acts, "doc_id", "text").withColumn("w", F.monotonically_increasing_id())
    cited = atoms(acts, "doc_id", "text").where("kind = 'citation'").select("doc_id", "value").distinct().withColumn("kind", F.lit("citation"))
    known = numbers.select("doc_id", "value").distinct().withColumn("kind", F.lit("number")).unionByName(cited).withColumn("known", F.lit(True))
    words = numbers.select("doc_id", F.col("value").alias("other"), "w", F.size("near").alias("n_b"), F.explode("near").alias("word"))
    asked = said.select("answer_id", "doc_id", "start", "value", F.size("near").alias("n_a"), F.explode("near").alias("word"))
    met = asked.join(words, ["doc_id", "word"]).groupBy("answer_id", "start", "value", "n_a", "w", "other", "n_b").agg(F.count(F.lit(1)).alias("both"))
    met = met.withColumn("j", F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).where(F.col("j") >= alike)
    if mode == "best_window":
        best = met.groupBy("answer_id", "start").agg(F.max_by("other", F.struct("j", "other")).alias("conflict"), F.first("value").alias("value")).where("conflict <> value").drop("value")
    elif mode == "any_window":
        best = met.where("other <> value").groupBy("answer_id", "start").agg(F.min("other").alias("conflict"))
    else:
        raise ValueError(f"unknown mode: {mode!r}")
    rows = said.join(known, ["doc_id", "value", "kind"], "left").join(best, ["answer_id", "start"], "left")
    lacking = F.when(F.col("kind") == "citation", "b").otherwise("a")
    rule = F.when(F.col("is_range") | F.col("hedged"), "unclear").when(F.col("known").isNull(), lacking).when(F.col("conflict").isNotNull(), "c")
    return rows.select("answer_id", "doc_id", "start", "end", "kind", "text", "value", "unit", rule.alias("rule"), "conflict")


def answer_categories(labels: DataFrame) -> DataFrame:
    """(answer_id, n_atoms, n_unclear, n_spans, rules, category) of labelled()."""
    wrong = F.col("rule").isin("a", "b", "c")
    out = labels.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.count_if(F.col("rule") == "unclear").alias("n_unclear"), F.count_if(wrong).alias("n_spans"), F.sort_array(F.collect_set(F.when(wrong, F.col("rule")))).alias("rules"))
    return out.withColumn("category", F.when(F.col("n_spans") > 0, "erroneous").when(F.col("n_unclear") > 0, "unclear").otherwise("clean"))


def char_labels(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """tokens with label 1 where a span of the same key overlaps them."""
    from plumbline.operators.spans import labelled as by_spans

    return by_spans(tokens, spans, key)
