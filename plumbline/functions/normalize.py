"""Text brought to one form for matching: numbers as digits, units, dates, stems; and the smaller text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx

LETTERS = "А-Яа-яЁёA-Za-z"
#: A word, or what stands between words.
PIECE = rf"[{LETTERS}]+(?:[-'][{LETTERS}]+)*|[^{LETTERS}]+"
WORD = rf"[{LETTERS}]+(?:[-'][{LETTERS}]+)*"
NUMERAL = r"[0-9]+(?:[.,][0-9]+)?"
NOT_IN_WORD, WORD_FOLLOWS, WORD_ENDS = r"(?<![\p{L}\p{N}_])", r"(?=[\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _none(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def has_number(text: Column) -> Column:
    """Does a text hold a number (dates and amounts have one)?"""
    return _none(text).rlike(r"[0-9]")


def number_of_words(words: Column) -> Column:
    """The number that a list of number words stands for; null if one is none or there are none. Thousands multiply what stands before them."""
    table = F.create_map(*(F.lit(x) for pair in lex.NUMBER_PARTS.items() for x in pair))
    values = F.transform(words, lambda w: F.try_element_at(table, F.lower(w)))
    state = lambda total, now: F.struct(total.cast("long").alias("total"), now.cast("long").alias("now"))
    whole = F.aggregate(
        values, state(F.lit(0), F.lit(0)),
        lambda a, v: F.when(v >= 1000, state(a["total"] + F.greatest(a["now"], F.lit(1)) * v, F.lit(0))).otherwise(state(a["total"], a["now"] + v)),
        lambda a: a["total"] + a["now"],
    )
    return F.when((F.size(words) > 0) & F.forall(values, lambda v: v.isNotNull()), whole)


def digits_for_words(text: Column) -> Column:
    """Runs of number words replaced by digits, what stands between the words of a run included."""
    table = F.create_map(*(F.lit(x) for pair in lex.NUMBER_PARTS.items() for x in pair))
    pieces = F.transform(
        F.regexp_extract_all(_none(text), F.lit(f"({PIECE})"), F.lit(1)),
        lambda p: F.struct(p.alias("text"), p.rlike(f"^[{LETTERS}]").alias("is_word"), F.try_element_at(table, F.lower(p)).alias("value")),
    )

    def state(out: Column, gap: Column, total: Column, now: Column, open_: Column) -> Column:
        return F.struct(out.alias("out"), gap.alias("gap"), total.cast("long").alias("total"), now.cast("long").alias("now"), open_.alias("open"))

    zero, none = F.lit(0), F.lit("")

    def closed(a: Column) -> Column:
        return F.concat(a["out"], F.when(a["open"], F.concat((a["total"] + a["now"]).cast("string"), a["gap"])).otherwise(""))

    def step(a: Column, p: Column) -> Column:
        number = F.when(
            p["value"] >= 1000, state(a["out"], none, a["total"] + F.greatest(a["now"], F.lit(1)) * p["value"], zero, F.lit(True))
        ).otherwise(state(a["out"], none, a["total"], a["now"] + p["value"], F.lit(True)))
        between = state(a["out"], F.concat(a["gap"], p["text"]), a["total"], a["now"], F.lit(True))
        other = state(F.concat(closed(a), p["text"]), none, zero, zero, F.lit(False))
        return F.when(p["value"].isNotNull(), number).when(a["open"] & ~p["is_word"], between).otherwise(other)

    return F.aggregate(pieces, state(none, none, zero, zero, F.lit(False)), step, closed)


def normalized_units(text: Column) -> Column:
    """Units in their canonical form, longer forms first. A form with a full stop counts where a word follows at once."""
    out = text
    for form in sorted(lex.UNITS, key=len, reverse=True):
        left = NOT_IN_WORD if form[0].isalpha() else ""
        right = WORD_ENDS if form[-1].isalpha() else WORD_FOLLOWS if form[-1] == "." else ""
        out = F.regexp_replace(out, rf"(?iu){left}\Q{form}\E{right}", lex.UNITS[form])
    return out


def normalized_dates(text: Column) -> Column:
    """Dates as DD.MM.YYYY: a day, a month's name and a year, or digits with dots (two-digit years are of this century)."""
    out = text
    for i, month in enumerate(lex.MONTHS, 1):
        tail = rf"\s*(?:г(?:ода)?\.?)?(?![{LETTERS[:8]}])"
        for day, zero in (("[0-9]{2}", ""), ("[0-9]", "0")):
            out = F.regexp_replace(out, rf"(?iu){NOT_IN_WORD}({day})\s+{month}\s+([0-9]{{4}}){tail}", f"{zero}$1.{i:02d}.$2")
    year = r"([0-9]{2,4})"
    for day, month, put in (("[0-9]{2}", "[0-9]{2}", "$1.$2"), ("[0-9]", "[0-9]{2}", "0$1.$2"), ("[0-9]{2}", "[0-9]", "$1.0$2"), ("[0-9]", "[0-9]", "0$1.0$2")):
        # A marked year is one that this pass has seen, so that a date is read once.
        out = F.regexp_replace(out, rf"{NOT_IN_WORD}(?<!\x01)({day})[.]({month})[.]{year}{WORD_ENDS}", f"\x01{put}.\x01$3")
    out = F.regexp_replace(out, rf"\x01([0-9.]+)\x01([0-9]{{2}}){WORD_ENDS}", "$120$2")
    return F.translate(out, "\x01", "")


def normalized_numbers(text: Column) -> Column:
    """Numbers, then dates, then units."""
    return normalized_units(normalized_dates(digits_for_words(text)))


def stemmed(word: Column) -> Column:
    """The word in lower case, ё as е, without the first ending of the list that leaves three letters; words of four letters stay.

    The list goes from long to short, so the first is the longest: what the shortest
    beginning of three letters or more leaves."""
    low = F.translate(F.lower(word), "ё", "е")
    return F.when(F.length(low) <= 4, low).otherwise(F.regexp_replace(low, f"^(.{{3,}}?)(?:{'|'.join(lex.ENDINGS)})$", "$1"))


def stems_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(_none(text), F.lit(f"({WORD})"), F.lit(1)), stemmed)


def for_match(text: Column) -> Column:
    """Stems and numbers of the normalised text, joined by blanks."""
    found = F.regexp_extract_all(normalized_numbers(_none(text)), F.lit(f"([{LETTERS}]+|{NUMERAL})"), F.lit(1))
    return F.array_join(F.transform(found, lambda t: F.when(t.rlike(f"^[{LETTERS}]"), stemmed(t)).otherwise(t)), " ")


def without_search_stop_words(terms: Column) -> Column:
    """Search terms of two characters or more that aren't stop words."""
    return F.filter(terms, lambda t: ~t.isin(lex.SEARCH_STOP_WORDS) & (F.length(t) > 1))


def within_limit(text: Column, limit: int = lex.MOST_CHARS) -> Column:
    return F.length(_none(text)) <= limit


def length_problem(text: Column, name: str, limit: int = lex.MOST_CHARS) -> Column:
    """What is wrong with a text's length; null if nothing is."""
    return F.when(~within_limit(text, limit), F.concat(F.lit(f"{name}: "), F.length(text).cast("string"), F.lit(f" characters, {limit} at most")))


def title_words(name: Column, most: int = 6) -> Column:
    """The first significant words of a title: six letters or more, no stop words."""
    found = F.regexp_extract_all(_none(name), F.lit("([А-Яа-яЁё]{6,})"), F.lit(1))
    return F.slice(F.filter(found, lambda w: ~F.lower(w).isin(lex.TITLE_STOP_WORDS)), 1, most)


def plain_value(text: Column) -> Column:
    """A number as rule labels compare it: without blanks, a comma as a dot, no dots at the ends."""
    return F.btrim(F.translate(F.regexp_replace(text, r"[ \x{A0}]", ""), ",", "."), F.lit("."))


def unclear_near(text: Column, start: Column, end: Column, reach: int = 90) -> Column:
    """Does a hedge stand within reach of text[start:end]?"""
    left = F.greatest(F.lit(0), start - reach)
    near = F.lower(F.substring(text, left + 1, F.least(F.length(text), end + reach) - left))
    return F.exists(F.array(*map(F.lit, lex.HEDGES)), lambda h: F.contains(near, h))


def joined_context(chunks: Column) -> Column:
    """A context given as a list of texts: those that aren't blank, a line each."""
    return F.array_join(F.filter(chunks, lambda c: F.btrim(c, F.lit(tx.BLANKS)) != ""), "\n")


def context_of_list(chunks: Column) -> Column:
    """text, chunks and their positions of a context given as a list of texts."""
    kept = F.filter(chunks, lambda c: F.btrim(c, F.lit(tx.BLANKS)) != "")
    places = F.transform(kept, lambda c, i: F.aggregate(F.slice(kept, 1, i), F.lit(0), lambda n, x: n + F.length(x) + 1))
    return F.struct(F.array_join(kept, "\n").alias("text"), kept.alias("chunks"), F.coalesce(places, F.array().cast("array<int>")).alias("positions"))


def finite(value: Column) -> Column:
    """A double as JSON can hold it: null for NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def layer_index(name: Column, total: int) -> Column:
    """The index of a layer given by name or number, within [0, total - 1]; unknown names give the last."""
    key = F.lower(F.btrim(name, F.lit(tx.BLANKS)))
    number = F.when(key.rlike(r"^[+-]?[0-9]{1,9}$"), key.cast("int"))
    index = F.when(key == "first", 0).when(key == "middle", (total - 1) // 2).when(number.isNull(), total - 1)
    index = index.otherwise(F.when(number >= 0, number).otherwise(number + total))
    return F.greatest(F.lit(0), F.least(F.lit(total - 1), index)) if total > 0 else F.lit(0)
