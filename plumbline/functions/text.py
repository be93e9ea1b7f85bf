"""Tokens, sentences, words, stems and character grams as Column expressions.

Character classes are written out, as \\w, \\s and \\b differ between engines. All
offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex

SPACE = r"[ \t\n\x0B\f\r\x{A0}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
TOKEN = rf"(?:{WORD_CHAR}+(?:[-'’]{WORD_CHAR}+)*|[^\p{{L}}\p{{N}}_ \t\n\x0B\f\r\x{{A0}}]){SPACE}*"
#: End of a sentence, its blanks, and the start of the next.
BREAK = r"([.!?…][ \t]+)([«\"(]?[A-ZА-ЯЁ0-9])"
MARK = "\x01"
BLANKS = " \t\n\x0b\f\r\xa0"


def plain(word: Column) -> Column:
    """Lower-cased, ё as е, without punctuation at the ends."""
    return F.btrim(F.translate(F.lower(F.btrim(word, F.lit(BLANKS))), "ё", "е"), F.lit(lex.EDGES))


def token_array(text: Column) -> Column:
    """Tokens with the blanks that follow them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def lead_length(text: Column) -> Column:
    """Length of the blanks before the first token."""
    return F.length(F.regexp_extract(F.coalesce(text, F.lit("")), rf"^{SPACE}*", 0))


def placed(rows: DataFrame, keys: list[str], pieces: Column, lead: Column) -> DataFrame:
    """(keys..., idx, text, start, end): pieces that follow each other from lead on, with half-open offsets."""
    out = rows.select(*keys, lead.alias("lead"), F.posexplode(pieces).alias("idx", "text"))
    until = F.sum(F.length("text")).over(W.partitionBy(*keys).orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = out.withColumn("end", (F.col("lead") + until).cast("int"))
    return out.select(*keys, "idx", "text", (F.col("end") - F.length("text")).alias("start"), "end")


def located(text: Column, pattern: str, wanted) -> Column:
    """Array of (at, text) of the pieces that are wanted (a test of a piece's text); the pattern cuts all of a text into pieces, at is the offset."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    found = "array<struct<at:int,text:string>>"
    state = lambda at, held: F.struct(at.cast("int").alias("at"), held.cast(found).alias("found"))

    def step(a: Column, p: Column) -> Column:
        own = F.array(F.struct(a["at"].alias("at"), p.alias("text")))
        return state(a["at"] + F.length(p), F.when(wanted(p), F.concat(a["found"], own)).otherwise(a["found"]))

    return F.aggregate(pieces, state(F.lit(0), F.array()), step, lambda a: a["found"])


def chosen(pieces: Column, wanted) -> Column:
    """Array of (idx, text, start) of the pieces that are wanted (a test of a piece); pieces follow each other from 0 on."""
    found = "array<struct<idx:int,text:string,start:int>>"
    state = lambda idx, at, held: F.struct(idx.cast("int").alias("idx"), at.cast("int").alias("at"), held.cast(found).alias("found"))

    def step(a: Column, p: Column) -> Column:
        own = F.array(F.struct(a["idx"].alias("idx"), p.alias("text"), a["at"].alias("start")))
        return state(a["idx"] + 1, a["at"] + F.length(p), F.when(wanted(p), F.concat(a["found"], own)).otherwise(a["found"]))

    return F.aggregate(pieces, state(F.lit(0), F.lit(0), F.array()), step, lambda a: a["found"])


def tokens(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Tokens of a text column with offsets; the blanks after a token are part of it."""
    return placed(rows, keys, token_array(F.col(column)), lead_length(F.col(column)))


def sentence_array(text: Column) -> Column:
    """Sentences; the blanks at a break belong to the sentence before it."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), BREAK, f"$1{MARK}$2")
    return F.split(marked, MARK)


def sentences(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sentences with offsets; blank ones are left out."""
    return placed(rows, keys, sentence_array(F.col(column)), F.lit(0)).where(F.btrim(F.col("text"), F.lit(BLANKS)) != "")


def paragraphs(text: Column) -> Column:
    """Paragraphs: what stands between blank lines."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\x0B\f\r]*\n"), lambda p: F.btrim(p, F.lit(" \t\n\x0b\f\r")) != "")


def is_digits(word: Column) -> Column:
    return word.rlike(r"^\p{Nd}+$")


def is_scored(text: Column) -> Column:
    """Is a token one whose support is judged? Words of three letters or more, and numbers, but no short stop words."""
    word = plain(text)
    return ((F.length(word) >= 3) | is_digits(word)) & ~(word.isin(lex.STOP_WORDS) & (F.length(word) <= 3)) & (word != "")


def edge_word(text: Column) -> Column:
    """A token's word as written: without blanks and punctuation at the ends."""
    return F.btrim(F.btrim(text, F.lit(BLANKS)), F.lit(lex.EDGES))


def is_content(text: Column) -> Column:
    word = edge_word(text)
    return (F.length(word) >= 3) | is_digits(word)


def stem(word: Column) -> Column:
    """The first four characters of the plain word."""
    return F.substring(plain(word), 1, 4)


def grams(word: Column, n: int = 3) -> Column:
    """Distinct n-grams of the plain word between ^ and $; none for an empty word."""
    padded = F.concat(F.lit("^"), plain(word), F.lit("$"))
    found = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1))), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(plain(word) != "", F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), both / F.size(F.array_union(left, right))).otherwise(0.0)


def number_value(word: Column) -> Column:
    """The number that a word stands for, in canonical digits; null if it is none."""
    table = F.create_map(*(F.lit(str(x)) for pair in lex.NUMBER_WORDS.items() for x in pair))
    word = plain(word)
    digits = F.regexp_replace(word, r"^0+(?=\p{Nd})", "")
    return F.when(word.rlike(r"^[0-9]+$"), digits).otherwise(F.try_element_at(table, word))


def estimated_tokens(text: Column) -> Column:
    """Model tokens that a text is taken for."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / lex.CHARS_PER_TOKEN))).cast("int")


def for_retrieval(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), rf"{SPACE}+", " "))


def search_terms(text: Column) -> Column:
    """Lower-case runs of letters of two alphabets and digits, of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[а-яёa-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def stripped_tags(html: Column) -> Column:
    """Markup without tags, blanks collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"[ \t\n\x0B\f\r]+", " "))


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags; blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return stripped_tags(bare)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))


def occurrences(text: Column, part: Column) -> Column:
    """How often part stands in text, counted without overlap; 0 for an empty part."""
    return F.when(part != "", ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def first_place(text: Column, part: Column) -> Column:
    """Offset (from 0) of the first occurrence; null without one."""
    at = F.call_function("locate", part, text)
    return F.when((part != "") & (at > 0), at - 1)
