"""Checks of corpora and results: contexts in their sources, records compared, states complete, figures as texts round them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import metrics as mt


def contexts_in_sources(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, problem) of pairs (id, doc_id, context) whose source (doc_id, text) is missing or doesn't hold the context."""
    rows = pairs.join(sources.select("doc_id", F.col("text").alias("source")), "doc_id", "left")
    problem = F.when(F.col("source").isNull(), "no source").when(~F.contains("source", "context"), "not in its source")
    return rows.select("id", problem.alias("problem")).where("problem is not null")


def values_outside(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, elsewhere): whether the value of a pair (id, doc_id, value, start, end) also stands in its source outside the span."""
    rows = pairs.join(sources.select("doc_id", "text"), "doc_id")
    around = F.concat(F.left("text", F.col("start")), F.lit("\x01"), F.substring("text", F.col("end") + 1, F.length("text")))
    return rows.select("id", F.contains(around, F.col("value")).alias("elsewhere"))


def differences(actual: DataFrame, expected: DataFrame, key: str, fields: list[str], tolerance: float = 0.0) -> DataFrame:
    """(key, field, problem): records that only one side has, and fields that differ (numbers by more than the tolerance)."""
    a = actual.select(key, F.struct(*(F.col(f) for f in fields)).alias("a"))
    b = expected.select(key, F.struct(*(F.col(f) for f in fields)).alias("b"))
    rows = a.join(b, key, "full")
    numeric = {f for f, t in actual.select(*fields).dtypes if t in ("int", "bigint", "double", "float")}

    def differs(f: str) -> Column:
        x, y = F.col("a").getField(f), F.col("b").getField(f)
        far = F.coalesce(F.abs(x - y) > tolerance, F.lit(False)) if f in numeric else F.lit(False)
        return (far | (x.isNull() != y.isNull())) if f in numeric else ~x.eqNullSafe(y)

    problems = F.when(F.col("b").isNull(), F.array(F.struct(F.lit("").alias("field"), F.lit("not expected").alias("problem")))).when(F.col("a").isNull(), F.array(F.struct(F.lit("").alias("field"), F.lit("missing").alias("problem"))))
    each = F.array_compact(F.array(*(F.when(differs(f), F.struct(F.lit(f).alias("field"), F.lit("differs").alias("problem"))) for f in fields)))
    return rows.select(key, F.explode(problems.otherwise(each)).alias("p")).select(key, "p.*")


def state_problems(states: DataFrame, corpus: DataFrame, key: str, group: str, fold: str) -> DataFrame:
    """(name, problem): keys of a corpus that states lack, hold twice or don't know, and groups in more than one fold."""
    counts = states.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = corpus.select(key).distinct().withColumn("there", F.lit(True)).join(counts, key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("there").isNull(), "unknown").when(F.col("n") > 1, "twice")
    keys = both.select(F.col(key).cast("string").alias("name"), problem.alias("problem")).where("problem is not null")
    torn = states.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1").select(F.col(group).cast("string").alias("name"), F.lit("in several folds").alias("problem"))
    return keys.unionByName(torn)


def roundings(value: Column, digits: int = 4) -> Column:
    """A number as texts may write it: rounded to 0 .. digits places, as a percentage too, with a point or a comma."""
    shown = [F.format_number(v, d) for v, most in ((value, digits), (value * 100, 2)) for d in range(most + 1)]
    plain = F.array_distinct(F.array(*(F.replace(s, F.lit(","), F.lit("")) for s in shown)))
    return F.array_sort(F.array_distinct(F.concat(plain, F.transform(plain, lambda s: F.replace(s, F.lit("."), F.lit(","))))))


def unsupported_figures(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, figure): numbers of texts (id, text) that round none of the known values (value)."""
    said = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1)))).alias("figure"))
    shown = known.select(F.explode(roundings(F.col("value"))).alias("figure")).distinct()
    return said.join(shown, "figure", "left_anti")


def field_at(payload: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; null without it."""
    return F.get_json_object(payload, "$." + path)


def merged_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, value): the newer value of every key, the older one where there is no newer."""
    return old.select(key, F.col("value").alias("was")).join(new.select(key, F.col("value").alias("now")), key, "full").select(key, F.coalesce("now", "was").alias("value"))


def best_candidate(rows: DataFrame, key: str, reference: str, candidate: str, order: str) -> DataFrame:
    """(key, candidate, rouge): of a key's candidates the one most like the reference by the mean of its one- and two-character overlaps; the first of equal ones."""
    named = rows.withColumn("row_id", F.struct(key, order))
    one = mt.rouge_n(named, "row_id", reference, candidate, 1).withColumnRenamed("rouge", "r1")
    two = mt.rouge_n(named, "row_id", reference, candidate, 2).withColumnRenamed("rouge", "r2")
    scored = named.join(one, "row_id").join(two, "row_id").withColumn("rouge", F.round((F.col("r1") + F.col("r2")) / 2, 9))
    best = scored.groupBy(key).agg(F.max_by(F.struct(F.col(candidate).alias("candidate"), "rouge"), F.struct("rouge", -F.col(order))).alias("b"))
    return best.select(key, "b.candidate", "b.rouge")


def span_diagnostics(predicted: DataFrame, gold: DataFrame, keys: DataFrame) -> DataFrame:
    """(source, predicted, fp_clean, fp_dirty, low_iou, hits): predicted spans (pair_id, start, end, source) by what they meet; clean pairs have no gold span."""
    g = gold.select(F.col("pair_id").alias("of"), F.col("start").alias("s"), F.col("end").alias("e"))
    share = mt.iou(F.col("start"), F.col("end"), F.col("s"), F.col("e"))
    best = predicted.select("pair_id", "start", "end", "source").join(g, F.col("pair_id") == F.col("of"), "left").groupBy("pair_id", "start", "end", "source").agg(F.max(share).alias("best"), F.count("of").alias("gold"))
    best = best.join(keys.select("pair_id"), "pair_id", "left_semi")
    some = F.coalesce("best", F.lit(0.0))
    return best.groupBy("source").agg(F.count(F.lit(1)).alias("predicted"), F.count_if(F.col("gold") == 0).alias("fp_clean"), F.count_if((F.col("gold") > 0) & (some == 0)).alias("fp_dirty"), F.count_if((some > 0) & (some < 0.5)).alias("low_iou"), F.count_if(some >= 0.5).alias("hits"))


def neighbour_diagnostics(tokens: DataFrame, key: str, order: str, risk: str, label: str, flag: str, k: int = 1) -> DataFrame:
    """(outcome, n, own, beside): mean risk of true and false, found and missed tokens, and of the k on either side."""
    w = W.partitionBy(key).orderBy(order)
    sides = [f(risk, d).over(w) for d in range(1, k + 1) for f in (F.lag, F.lead)]
    there = reduce(lambda a, b: a + b, (F.when(s.isNotNull(), 1).otherwise(0) for s in sides))
    beside = F.try_divide(reduce(lambda a, b: a + b, (F.coalesce(s, F.lit(0.0)) for s in sides)), there)
    outcome = F.when((F.col(label) == 1) & F.col(flag), "tp").when(F.col(label) == 1, "fn").when(F.col(flag), "fp").otherwise("tn")
    rows = tokens.select(outcome.alias("outcome"), F.col(risk).alias("own"), beside.alias("beside"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("own").alias("own"), F.avg("beside").alias("beside"))


def levels(tokens: DataFrame, key: str, score: str, label: str, threshold: float) -> DataFrame:
    """(level, tp, fp, fn, tn, precision, recall, f1, fpr) of tokens, and of answers by their highest token."""
    answers = tokens.groupBy(key).agg(F.max(score).alias("s"), F.max((F.col(label) == 1).cast("int")).alias("y")).select(F.lit("answer").alias("level"), "s", "y")
    rows = tokens.select(F.lit("token").alias("level"), F.col(score).alias("s"), (F.col(label) == 1).cast("int").alias("y")).unionByName(answers)
    return mt.confusion(rows, F.col("y"), F.col("s") >= threshold, ["level"]).drop("accuracy")


def character_windows(tokens: DataFrame, key: str, most: int) -> DataFrame:
    """(key, window, first, last, start, end): tokens (idx, start, end) in windows of `most`; tokens that share an offset stay in one."""
    w = W.partitionBy(key).orderBy("start", "idx")
    rows = tokens.withColumn("place", F.row_number().over(w) - 1)
    rows = rows.withColumn("head", F.min("place").over(W.partitionBy(key, "start")))
    rows = rows.withColumn("window", F.floor(F.col("head") / most).cast("int"))
    return rows.groupBy(key, "window").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))


def to_sentences(spans: DataFrame, documents: DataFrame, words: DataFrame, key: str, column: str, least: int) -> DataFrame:
    """(key, start, end, n_tokens, mean, peak): spans widened to the sentences that they touch, joined where they meet; of at least `least` words (key, start, end, probability)."""
    from plumbline.functions import style

    bounds = style.sentences(documents, [key], column).select(F.col(key).alias("of"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("text").alias("sentence"))
    met = spans.join(bounds, (F.col(key) == F.col("of")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))).select(key, "s", "e", "sentence").distinct()
    w = W.partitionBy(key).orderBy("s")
    met = met.withColumn("fresh", F.when(F.col("s") <= F.lag("e").over(w), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    lead = F.length("sentence") - F.length(F.ltrim(F.col("sentence"), F.lit(tx.BLANKS)))
    trail = F.length("sentence") - F.length(F.rtrim(F.col("sentence"), F.lit(tx.BLANKS)))
    runs = met.groupBy(key, "run").agg(F.min_by(F.col("s") + lead, "s").alias("a"), F.max_by(F.col("e") - trail, "s").alias("b")).select(F.col(key).alias("of"), "a", "b")
    inside = words.join(runs, (F.col(key) == F.col("of")) & (F.col("start") >= F.col("a")) & (F.col("end") <= F.col("b")))
    out = inside.groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("n_tokens"), F.avg("probability").alias("mean"), F.max("probability").alias("peak"))
    return out.where(F.col("n_tokens") >= least).select(key, F.col("a").alias("start"), F.col("b").alias("end"), "n_tokens", "mean", "peak")


def closed(text: Column, end: Column) -> Column:
    """A span's end moved over up to four signs that close it, and blanks between them."""
    return (end + F.length(F.regexp_extract(F.substring(text, end + 1, F.lit(40)), r"^(?:[ \t\n\x0B\f\r]*[.,;:!?…»\")\]]){0,4}", 0))).cast("int")


def text_verdict(score: Column, threshold: float, margin: float = 0.1) -> Column:
    """What a detector's score says of a text: machine, mixed near the threshold, human."""
    return F.when(score >= threshold + margin, "machine").when(score >= threshold - margin, "mixed").otherwise("human")
