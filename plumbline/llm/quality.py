"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every metric is an expression over the row's own text, its words or its lines, so
there is no shuffle and no user function. Repeated three-word windows are found by
sorting one array of packed longs (hash bits above, position bits below) per text,
which takes n log n steps for n words however repetitive the text is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, split_words

STOP_WORDS = (
    "the of and to in that is was for it with as on be by at this have from or an are not a "
    "der die das und den von zu mit sich des ist im für auf dem ein eine nicht als "
    "de la le les et en un une du que est pour dans qui par sur au ne pas "
    "el los las y del se con su por es para"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if metric / per is below `least` or above `most`."""

    name: str
    metric: str
    per: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("length", "n_words", "one", 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 3, 10),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.08, None),
    Rule("letters", "n_letter_words", "n_words", 0.8, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur at least twice in the text."""

    def windows(hashes: Column) -> Column:
        size = F.size(hashes)
        mask = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size, F.lit(2)) + 1))).cast("long") - F.lit(1).cast("long")
        return let(mask, lambda m: let(F.sort_array(packed(hashes, m)), lambda s: covered(s, m)))

    def packed(hashes: Column, mask: Column) -> Column:
        first = F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))
        return F.transform(first, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))

    def covered(found: Column, mask: Column) -> Column:
        high = lambda v: v.bitwiseAND(F.bitwise_not(mask))
        same = lambda v, w: F.coalesce(high(v) == high(w), F.lit(False))
        places = F.transform(found, lambda v, i: F.when(same(v, F.get(found, i + 1)) | same(v, F.get(found, i - 1)), v.bitwiseAND(mask)))
        return let(F.sort_array(F.filter(places, lambda v: v.isNotNull())), total)

    def total(places: Column) -> Column:
        steps = F.transform(places, lambda v, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, i + 1) - v, F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def metrics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Metric name -> expression (long); lines are those that hold a word."""
    count = lambda array, test: F.size(F.filter(array, test)).cast("long")
    bare = lambda w: F.btrim(F.lower(w), F.lit(".,;:!?\"'()"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_stop_words": count(words, lambda w: bare(w).isin(STOP_WORDS)),
        "n_letter_words": count(words, lambda w: w.rlike(r"\p{L}")),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_bullet_lines": count(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]")),
        "n_ellipsis_lines": count(lines, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$")),
        "n_repeat_words": repeated_words(words),
    }


def failed(rule: Rule) -> Column:
    """Does the row, which has the metrics as columns, break the rule? A ratio to nothing breaks none."""
    per = F.lit(1.0) if rule.per == "one" else F.col(rule.per).cast("double")
    ratio = F.col(rule.metric).cast("double") / F.when(per > 0, per)
    tests = [ratio < rule.least] * (rule.least is not None) + [ratio > rule.most] * (rule.most is not None)
    return F.coalesce(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(False))


def judged(documents: DataFrame, *, rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, all metrics, base_failed, failed_rules (names, comma-joined) and kept, for every row of documents (doc_id, text).

    base_failed: fewer than least_words words, or 100 * n_repeat_words above
    most_repeated * n_words. kept: base has not failed and no rule is broken. A null,
    empty or blank text has no words and lines and fails the base. Null ids and
    repeated rows are rows like others; an empty table gives none; other columns are
    not read."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", split_words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    rows = rows.select("doc_id", *(c.alias(n) for n, c in metrics(F.col("text"), F.col("words"), F.col("lines")).items()))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    names = F.array_join(F.array_compact(F.array(*(F.when(failed(r), F.lit(r.name)) for r in rules))), ",")
    return rows.withColumn("base_failed", base).withColumn("failed_rules", names).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def quality_sql(rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: int = 50) -> str:
    """DuckDB SQL for the query over documents."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)

    def test(r: Rule) -> str:
        ratio = f"{r.metric}::DOUBLE / " + ("1.0" if r.per == "one" else f"nullif({r.per}, 0)")
        tests = [f"{ratio} < {r.least}"] * (r.least is not None) + [f"{ratio} > {r.most}"] * (r.most is not None)
        return f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END"

    return rf"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    tokens AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM base),
    grams AS (SELECT doc_id, pos, word, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM grams WHERE w3 IS NOT NULL) WHERE n > 1),
    repeated AS (SELECT doc_id, count(DISTINCT pos + o) AS n FROM twice, range(3) t(o) GROUP BY doc_id),
    counted AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(list_filter(words, lambda x: trim(lower(x), '.,;:!?"''()') IN ({stop})))::BIGINT AS n_stop_words,
        len(list_filter(words, lambda x: regexp_matches(x, '\pL')))::BIGINT AS n_letter_words,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*\x{{2022}}]')))::BIGINT AS n_bullet_lines,
        len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '(\.\.\.|\x{{2026}})$')))::BIGINT AS n_ellipsis_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM base LEFT JOIN repeated r USING (doc_id)),
    judged AS (SELECT *, n_words < {least_words} OR 100 * n_repeat_words > {most_repeated} * n_words AS base_failed,
        array_to_string(list_filter([{", ".join(map(test, rules))}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM counted)
    SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM judged
    """
