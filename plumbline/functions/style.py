"""Tokens and sentences of the style detector: words and the gaps between them, and sentences that abbreviations don't end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx

WORD = r"[A-Za-zА-Яа-яЁё0-9]+(?:[-'’][A-Za-zА-Яа-яЁё0-9]+)*"
#: A word, or a character that starts none.
PIECE = rf"{WORD}|[^A-Za-zА-Яа-яЁё0-9]+"


def pieces(text: Column) -> Column:
    """Words and gaps, which together are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PIECE})"), F.lit(1))


def is_word(piece: Column) -> Column:
    return piece.rlike(r"^[A-Za-zА-Яа-яЁё0-9]")


def tokens(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys..., idx, text, start, end, kind): all of the text as words and gaps."""
    out = tx.placed(rows, keys, pieces(F.col(column)), F.lit(0))
    return out.withColumn("kind", F.when(is_word(F.col("text")), "word").otherwise("gap"))


def sentence_array(text: Column) -> Column:
    """Sentences with the blanks after them; a break after an abbreviation is none."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?…][ \t]+)(?=[«\"(]?[A-ZА-ЯЁ0-9])", "$1\x01")
    last = lambda p: F.lower(F.btrim(F.regexp_extract(p, r"([^\s«\"(]*)\s*$", 1), F.lit(".,!?…")))
    joined = F.array_join(F.transform(F.split(marked, "\x01"), lambda p: F.when(last(p).isin(lex.ABBREVIATIONS), p).otherwise(F.concat(p, F.lit("\x01")))), "")
    return F.split(F.regexp_replace(joined, "\x01$", ""), "\x01")


def sentences(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys..., idx, text, start, end) of sentences; blank ones are left out."""
    found = tx.placed(rows, keys, sentence_array(F.col(column)), F.lit(0))
    return found.where(F.btrim(F.col("text"), F.lit(tx.BLANKS)) != "")


def sentence_tokens(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys..., sentence, first, stop): the tokens that each sentence overlaps, half-open."""
    toks = tokens(rows, keys, column).select(*keys, "idx", "start", "end")
    parts = sentences(rows, keys, column).select(*keys, F.col("idx").alias("sentence"), F.col("start").alias("s"), F.col("end").alias("e"))
    met = toks.join(parts, keys).where((F.col("end") > F.col("s")) & (F.col("start") < F.col("e")))
    return met.groupBy(*keys, "sentence").agg(F.min("idx").alias("first"), (F.max("idx") + 1).alias("stop"))
