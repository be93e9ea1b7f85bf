"""Lexical support of answer tokens by their context.

Comparisons run over distinct words of a pair that share character grams, and counts
stand for repeated words; so a long context costs its vocabulary, not its length times
the answer's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx


def vocabulary(pairs: DataFrame, column: str) -> DataFrame:
    """(pair_id, word, n, stem): distinct content words of a text column with their counts."""
    words = pairs.select("pair_id", F.explode(tx.token_array(F.col(column))).alias("token")).where(tx.is_content(F.col("token")))
    words = words.groupBy("pair_id", tx.plain(F.col("token")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("stem", tx.stem(F.col("word")))


#: Cells of the table of answer by context words that a task holds at once.
CELLS = 1 << 22


class Grams(dict):
    """Word -> numbers of its distinct character trigrams; emptied when it holds too many words."""

    MOST = 200_000

    def __init__(self) -> None:
        super().__init__()
        self.numbers: dict[str, int] = {}

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= self.MOST:
            self.clear()
        padded = f"^{word}$"
        found = {padded[i : i + 3] for i in range(max(1, len(padded) - 2))} if word else set()
        out = self[word] = np.fromiter((self.numbers.setdefault(g, len(self.numbers)) for g in found), np.int64, len(found))
        return out


def most_alike(grams: Grams, asked: list[str], known: list[str], counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each asked word its best Jaccard similarity to a known one, and the mean of its k best, repeats counted."""
    best, mean = np.zeros(len(asked)), np.zeros(len(asked))
    if not known:
        return best, mean
    held = [grams[w] for w in known]
    size = np.array([len(g) for g in held])
    flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    wanted = min(k, int(counts.sum()))
    block = max(1, CELLS // len(known))
    for at in range(0, len(asked), block):
        own = [grams[w] for w in asked[at : at + block]]
        mine = np.array([len(g) for g in own])
        ask = np.concatenate(own)
        row = np.repeat(np.arange(len(own)), mine)
        first, last = np.searchsorted(flat, ask), np.searchsorted(flat, ask, side="right")
        n = last - first
        places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(np.repeat(row, n) * len(known) + owner[places], minlength=len(own) * len(known)).reshape(len(own), -1)
        share = both / np.maximum(1, mine[:, None] + size[None, :] - both)
        best[at : at + block] = share.max(axis=1)
        top = np.argpartition(-share, min(k, len(known)) - 1, axis=1)[:, :k]
        values = np.take_along_axis(share, top, axis=1)
        ranks = np.argsort(-values, axis=1, kind="stable")
        values, times = np.take_along_axis(values, ranks, axis=1), counts[np.take_along_axis(top, ranks, axis=1)]
        taken = np.clip(wanted - (np.cumsum(times, axis=1) - times), 0, times)
        mean[at : at + block] = (values * taken).sum(axis=1) / max(1, wanted)
    return best, mean


def similarities(asked: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """(pair_id, word, max_sim, top_mean): for each distinct answer word its best gram similarity and the mean of its k best.

    Repeated context words count as often as they occur; with fewer than k context words
    the mean is over those. A pair's two vocabularies meet in one row, so nothing is
    shuffled for each gram; a task holds CELLS cells of their table at once."""
    left = asked.groupBy("pair_id").agg(F.collect_list("word").alias("asked"))
    right = known.groupBy("pair_id").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for pair, words, others, counts in zip(*batch.columns, strict=True):
                words = words.as_py()
                best, mean = most_alike(grams, words, others.as_py(), np.array(counts.as_py(), np.int64), k)
                yield pa.RecordBatch.from_arrays([pa.array([pair.as_py()] * len(words), pair.type), pa.array(words, pa.string()), pa.array(best), pa.array(mean)], ["pair_id", "word", "max_sim", "top_mean"])

    kind = asked.schema["pair_id"].dataType.simpleString()
    return left.join(right, "pair_id").select("pair_id", "asked", "known", "counts").mapInArrow(run, f"pair_id {kind}, word string, max_sim double, top_mean double")


def supports(asked: DataFrame, known: DataFrame, likeness: DataFrame) -> DataFrame:
    """(pair_id, word, support, max_sim, top_mean): 1 if a context word has the same stem, else 0.7 times the best similarity."""
    stems = known.select("pair_id", "stem").distinct().withColumn("met", F.lit(True))
    rows = asked.join(stems, ["pair_id", "stem"], "left").join(likeness, ["pair_id", "word"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("pair_id", "word", F.when(F.col("met"), 1.0).otherwise(0.7 * zero(F.col("max_sim"))).alias("support"), zero(F.col("max_sim")).alias("max_sim"), zero(F.col("top_mean")).alias("top_mean"))


def number_groups(tokens: DataFrame, key: str = "pair_id") -> DataFrame:
    """Adds value: the number that a run of number tokens stands for (digits joined, or number words added up), else null."""
    own = tx.number_value(tx.edge_word(F.col("text")))
    rows = tokens.withColumn("__own", own)
    w = W.partitionBy(key).orderBy("idx")
    start = F.when(F.col("__own").isNotNull() & F.lag("__own").over(w).isNull(), 1).otherwise(0)
    rows = rows.withColumn("__run", F.when(F.col("__own").isNotNull(), F.sum(start).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))))
    table = F.create_map(*(F.lit(x) for k, v in lex.NUMBER_PARTS.items() for x in (k.replace("ё", "е"), v)))
    word = tx.plain(F.col("text"))
    whole = W.partitionBy(key, "__run").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    words = F.collect_list(F.when(F.col("__run").isNotNull(), word)).over(whole)
    parts = F.transform(words, lambda x: F.try_element_at(table, x))
    # Thousands multiply what stands before them, all else adds up.
    folded = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now")),
        lambda a, v: F.when(v >= 1000, F.struct((a["total"] + F.greatest(a["now"], F.lit(1)) * v).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))).otherwise(F.struct(a["total"].alias("total"), (a["now"] + v).cast("long").alias("now"))),
        lambda a: a["total"] + a["now"],
    )
    digits = F.forall(words, lambda x: x.rlike("^[0-9]+$"))
    joined = F.regexp_replace(F.array_join(words, ""), "^0+(?=[0-9])", "")
    value = F.when(digits, joined).when(F.forall(parts, lambda x: x.isNotNull()), folded.cast("string"))
    return rows.withColumn("value", F.when(F.col("__run").isNotNull(), value)).drop("__own", "__run")


def context_numbers(pairs: DataFrame) -> DataFrame:
    """(pair_id, numbers): distinct numbers of the context; runs of number words and single words both count."""
    toks = number_groups(tx.tokens(pairs, ["pair_id"], "context"))
    return toks.where("value is not null").groupBy("pair_id").agg(F.collect_set("value").alias("numbers"))


def measured(tokens: DataFrame, key: str, value: Column) -> DataFrame:
    """Adds subject: up to six words before a number token, back to a sentence's end, without connecting words."""
    word = tx.plain(F.col("text"))
    w = W.partitionBy(key).orderBy("idx")
    ends = F.btrim(F.col("text"), F.lit(tx.BLANKS)).rlike(r"[.!?…;:]$")
    rows = tokens.withColumn("__word", word).withColumn("__value", value)
    rows = rows.withColumn("__part", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    usable = (F.col("__word") != "") & ~F.col("__word").isin(lex.SUBJECT_SKIP) & ~F.col("__word").rlike("^[0-9]+$") & ~ends
    # Each usable word carries the ones before it, and a number takes what the last of them carries.
    own = W.partitionBy(key, "__part", "__usable").orderBy("idx")
    window = F.array(*(F.lag("__word", d).over(own) for d in range(lex.SUBJECT_WINDOW - 1, 0, -1)), F.col("__word"))
    rows = rows.withColumn("__usable", usable).withColumn("__near", F.when(F.col("__usable"), F.array_compact(window)))
    before = W.partitionBy(key, "__part").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("subject", F.coalesce(F.last("__near", ignorenulls=True).over(before), F.array().cast("array<string>")))
    rows = rows.withColumn("__before", F.lag("__word").over(w))
    return rows.withColumn("is_document", F.coalesce(F.substring("__before", 1, 4).isin(lex.DOCUMENT_STEMS), F.lit(False))).drop("__word", "__part", "__before", "__usable", "__near")


def measurements(pairs: DataFrame) -> DataFrame:
    """(pair_id, idx, start, end, value, subject): numbers of the context with the words that say what they measure."""
    toks = tx.tokens(pairs, ["pair_id"], "context")
    rows = measured(toks, "pair_id", tx.number_value(tx.edge_word(F.col("text")))).withColumnRenamed("__value", "value")
    return rows.where(F.col("value").isNotNull() & ~F.col("is_document")).select("pair_id", "idx", "start", "end", "value", "subject")


def attributions(pairs: DataFrame) -> DataFrame:
    """(pair_id, start, end, value, matched_value): answer numbers that belong to another subject of the context.

    Subjects of the context are reduced to the stems that not all of them share. An
    answer number is matched to the measurement whose stems its own subject holds best
    (half of them at least); if equally good ones disagree, to none. It is reported if
    the match has another value while a different measurement has the answer's."""
    stems = lambda c: F.array_distinct(F.transform(c, lambda x: F.substring(x, 1, 4)))
    known = measurements(pairs).withColumn("stems", stems(F.col("subject")))
    every = W.partitionBy("pair_id")
    known = known.withColumn("many", F.count(F.lit(1)).over(every)).where("many > 1")
    spread = known.select("pair_id", "many", F.explode("stems").alias("stem")).groupBy("pair_id", "stem", "many").agg(F.count(F.lit(1)).alias("n")).where("n = many")
    common = spread.groupBy("pair_id").agg(F.collect_set("stem").alias("common"))
    known = known.join(common, "pair_id", "left").withColumn("own", F.array_except("stems", F.coalesce("common", F.array().cast("array<string>"))))
    known = known.withColumn("own", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("stems")))
    toks = number_groups(tx.tokens(pairs, ["pair_id"], "answer"))
    said = measured(toks, "pair_id", F.col("value")).where(F.col("value").isNotNull() & (F.size("subject") > 0))
    said = said.select("pair_id", "start", "end", F.col("value").alias("said"), stems(F.col("subject")).alias("mine"))
    met = said.join(known.select("pair_id", "idx", "value", "own"), "pair_id")
    met = met.withColumn("score", F.when(F.size("own") > 0, F.size(F.array_intersect("own", "mine")) / F.size("own")).otherwise(0.0))
    held = met.groupBy("pair_id", "start", "end", "said").agg(F.max("score").alias("best"), F.max_by("value", F.struct("score", -F.col("idx"))).alias("matched_value"), F.max_by("idx", F.struct("score", -F.col("idx"))).alias("at"))
    held = held.where(F.col("best") >= lex.MATCH_MIN)
    both = met.join(held, ["pair_id", "start", "end", "said"])
    rival = (F.col("idx") != F.col("at")) & (F.col("score") >= F.greatest(F.lit(lex.MATCH_MIN), F.col("best") - 1e-9)) & (F.col("value") != F.col("matched_value"))
    elsewhere = (F.col("idx") != F.col("at")) & (F.col("value") == F.col("said"))
    judged = both.groupBy("pair_id", "start", "end", "said", "matched_value").agg(F.max(rival).alias("unclear"), F.max(elsewhere).alias("borrowed"))
    return judged.where(~F.col("unclear") & F.col("borrowed") & (F.col("matched_value") != F.col("said"))).select("pair_id", "start", "end", F.col("said").alias("value"), "matched_value")


def cliche_cover(tokens: DataFrame, key: str) -> DataFrame:
    """Adds in_cliche: is the token part of a set phrase of two to four words?"""
    word = F.translate(F.lower(F.btrim(F.col("text"), F.lit(tx.BLANKS))), "ё", "е")
    rows = tokens.withColumn("__w", word)
    w = W.partitionBy(key).orderBy("idx")
    by_size: dict[int, list[str]] = {}
    for phrase in lex.CLICHES:
        by_size.setdefault(len(phrase.split()), []).append(phrase)
    starts = {n: F.concat_ws(" ", *(F.lead("__w", i).over(w) if i else F.col("__w") for i in range(n))).isin(found) for n, found in by_size.items()}
    rows = rows.withColumns({f"__s{n}": s for n, s in starts.items()})
    cover = [F.coalesce(F.lag(f"__s{n}", i).over(w), F.lit(False)) if i else F.col(f"__s{n}") for n in by_size for i in range(n)]
    hit = cover[0]
    for c in cover[1:]:
        hit = hit | c
    return rows.withColumn("in_cliche", hit).drop("__w", *(f"__s{n}" for n in by_size))


def token_features(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Answer tokens with the five features of [0, 1]: entropy, mass, mass_norm, max_sim and density.

    entropy is how much a token reads like boilerplate; the others fall where the context
    doesn't support it. Numbers are supported by an equal number only, and not if it
    belongs to another subject."""
    toks = number_groups(tx.tokens(pairs, ["pair_id"], "answer"))
    toks = cliche_cover(toks, "pair_id").withColumn("word", tx.plain(F.col("text"))).withColumn("content", tx.is_content(F.col("text")))
    asked, known = vocabulary(pairs, "answer"), vocabulary(pairs, "context")
    words = supports(asked, known, similarities(asked, known, k))
    rows = toks.join(words, ["pair_id", "word"], "left").join(context_numbers(pairs), "pair_id", "left")
    rows = rows.join(attributions(pairs).select("pair_id", "start", "end", F.lit(True).alias("borrowed")), ["pair_id", "start", "end"], "left")
    content = F.col("content")
    zero = lambda c: F.when(content, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    number = F.col("value").isNotNull() & F.col("numbers").isNotNull()
    mass = F.when(F.col("borrowed"), 0.0).when(number, F.array_contains("numbers", F.col("value")).cast("double")).when(F.col("word").isin(lex.PARAPHRASES), 1.0).otherwise(zero("support"))
    seen = F.row_number().over(W.partitionBy("pair_id", "word").orderBy("idx")) > 1
    entropy = F.least(F.lit(1.0), F.when(F.col("word").isin([w.replace("ё", "е") for w in lex.BOILERPLATE]), 0.6).otherwise(0.0) + F.when(F.col("in_cliche"), 0.4).otherwise(0.0) + F.when(seen, 0.2).otherwise(0.0))
    rows = rows.withColumns({"entropy": entropy, "mass": mass, "max_sim": F.least(F.lit(1.0), zero("max_sim")), "density": F.least(F.lit(1.0), zero("top_mean") / lex.DENSITY_REFERENCE)})
    rows = mass_norm(rows)
    return rows.withColumn("scored", tx.is_scored(F.col("text"))).select("pair_id", "idx", "text", "start", "end", "value", F.coalesce("borrowed", F.lit(False)).alias("borrowed"), "content", "scored", *lex.WEIGHTS)


def mass_norm(rows: DataFrame) -> DataFrame:
    """Adds mass_norm: mass over the mean mass of the answer's content tokens, at most 1; other tokens keep their mass."""
    mean = F.avg(F.when(F.col("content"), F.col("mass"))).over(W.partitionBy("pair_id"))
    scaled = F.col("mass") / F.greatest(mean, F.lit(1e-9))
    return rows.withColumn("mass_norm", F.least(F.lit(1.0), F.when(F.col("content"), scaled).otherwise(F.col("mass"))))


def combined(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds risk: the weighted mean of entropy over its largest value in the answer, and of what lacks to full support."""
    weights = {**lex.WEIGHTS, **(weights or {})}
    total = sum(map(abs, weights.values())) or 1.0
    top = F.max("entropy").over(W.partitionBy("pair_id"))
    scaled = F.when(top > 1e-12, F.least(F.lit(1.0), F.col("entropy") / top)).otherwise(0.0)
    risk = weights["entropy"] * scaled + sum((weights[n] * (1 - F.col(n)) for n in weights if n != "entropy"), F.lit(0.0))
    return rows.withColumn("risk", F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk / total)))
