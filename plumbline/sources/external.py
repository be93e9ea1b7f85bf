"""Labelled datasets of others, brought to pairs: responses joined to their sources, spans found in answers, and what can't be verified."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as tx

FOUND = "array<struct<start:int,end:int,type:string>>"


def context_of_info(info: Column) -> Column:
    """The context in a source's JSON: a string as it is, of an object the passages if there are any, else its fields as lines."""
    fields = F.from_json(info, "map<string,string>")
    lines = F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "\n")
    passages = F.try_element_at(fields, F.lit("passages"))
    bare = F.btrim(info)
    other = F.raise_error(F.concat(F.lit("source information of an unknown kind: "), F.substring(info, 1, 80))).cast("string")
    card = F.when(F.btrim(passages) != "", passages).otherwise(lines)
    return F.when(F.startswith(bare, F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), bare, F.lit("}")), "v string")["v"]).when(F.startswith(bare, F.lit("{")), card).otherwise(other)


def stands(answer: Column, label: Column) -> Column:
    """Does a label (start, end, text) quote the answer?"""
    good = (label["start"] >= 0) & (label["start"] < label["end"]) & (label["end"] <= F.length(answer))
    return F.coalesce(good & (F.substring(answer, label["start"] + 1, label["end"] - label["start"]) == label["text"]), F.lit(False))


def adapted(rows: DataFrame) -> DataFrame:
    """rows with answer and labels (start, end, text, label_type) -> labels that stand, unverified ones, and how many quote words that occur again."""
    held = F.coalesce("labels", F.array())
    good = F.filter(held, lambda x: stands(F.col("answer"), x))
    out = rows.withColumn("unverified", F.filter(held, lambda x: ~stands(F.col("answer"), x)))
    out = out.withColumn("ambiguous", F.size(F.filter(good, lambda x: tx.occurrences(F.col("answer"), x["text"]) > 1)))
    return out.withColumn("labels", good)


def response_pairs(responses: DataFrame, sources: DataFrame, *, task: str | None = None, split: str | None = None, quality: str | None = "good") -> DataFrame:
    """(id, context, answer, labels, unverified, ambiguous, task, source_id, model, split, quality): responses with the context of their source.

    A response without a source fails. Sources are one row per source_id."""
    rows = responses
    for column, wanted in (("split", split), ("quality", quality)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    known = sources.select("source_id", F.col("task_type").alias("task"), context_of_info(F.col("source_info")).alias("context"), F.lit(True).alias("known"))
    met = rows.join(known, "source_id", "left")
    lost = F.raise_error(F.concat(F.lit("no source for "), F.col("source_id").cast("string"))).cast("string")
    met = met.withColumn("context", F.when(F.coalesce("known", F.lit(False)), F.col("context")).otherwise(lost))
    if task is not None:
        met = met.where(F.col("task") == task)
    out = adapted(met.withColumnRenamed("response", "answer"))
    return out.select("id", "context", "answer", "labels", "unverified", "ambiguous", "task", "source_id", "model", "split", "quality")


def totals(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., responses, sources, clean, with_labels, spans, unverified, ambiguous) of adapted pairs."""
    n = F.size("labels")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("responses"), F.count_distinct("source_id").alias("sources"), F.count_if(n == 0).alias("clean"), F.count_if(n > 0).alias("with_labels"),
        F.sum(n).cast("long").alias("spans"), F.sum(F.size("unverified")).cast("long").alias("unverified"), F.sum("ambiguous").cast("long").alias("ambiguous"))


def label_types(pairs: DataFrame) -> DataFrame:
    """(label_type, n) of the labels that stand."""
    return pairs.select(F.explode("labels").alias("l")).groupBy(F.col("l.label_type").alias("label_type")).agg(F.count(F.lit(1)).alias("n"))


def joined_documents(documents: Column) -> Column:
    """Documents in order, each under a line with its number."""
    parts = F.transform(documents, lambda d, i: F.concat(F.lit("\n\n[ДОКУМЕНТ "), (i + 1).cast("string"), F.lit("]\n"), F.coalesce(d, F.lit(""))))
    return F.btrim(F.array_join(parts, ""), F.lit(tx.BLANKS))


@F.pandas_udf(T.ArrayType(T.StringType()))
def documents_of_literal(raw: pd.Series) -> pd.Series:
    """The doc_text fields of a list of dicts written as a Python literal, which no JSON parser reads."""

    def read(text: str | None) -> list[str]:
        rows = ast.literal_eval(text or "[]")
        if not isinstance(rows, list):
            raise ValueError("the documents aren't a list")
        return [str(r.get("doc_text", "")) for r in rows]

    return raw.map(read)


def found_spans(answer: Column, annotation: Column, strict: bool = False) -> Column:
    """labels (start, end, type), unverified texts and ambiguous of an annotation [(span, type)] in JSON: each span where it first stands.

    strict fails on a span that the answer doesn't hold."""
    items = F.filter(F.coalesce(F.from_json(annotation, "array<struct<span:string,type:string>>"), F.array()), lambda x: F.coalesce(x["span"], F.lit("")) != "")
    place = lambda x: F.call_function("locate", x["span"], answer)
    there = F.filter(items, lambda x: place(x) > 0)
    lost = F.transform(F.filter(items, lambda x: place(x) == 0), lambda x: x["span"])
    if strict:
        lost = F.when(F.size(lost) > 0, F.raise_error(F.concat(F.lit("not in the answer: "), lost[0])).cast("array<string>")).otherwise(lost)
    labels = F.transform(there, lambda x: F.struct((place(x) - 1).alias("start"), (place(x) - 1 + F.length(x["span"])).alias("end"), F.coalesce(x["type"], F.lit("unknown")).alias("type")))
    return F.struct(labels.cast(FOUND).alias("labels"), lost.alias("unverified"), F.size(F.filter(there, lambda x: tx.occurrences(answer, x["span"]) > 1)).alias("ambiguous"))


def annotated_pairs(rows: DataFrame, source: str, strict: bool = False) -> DataFrame:
    """(id, context, answer, labels, unverified, ambiguous, source_id, query, clean) of rows (query_id, query_text, docs, model_output, answer)."""
    out = rows.withColumn("f", found_spans(F.col("model_output"), F.col("answer"), strict))
    return out.select(
        F.concat(F.lit(f"{source}-"), F.col("query_id").cast("string")).alias("id"), joined_documents(documents_of_literal("docs")).alias("context"), F.col("model_output").alias("answer"),
        F.col("f.labels").alias("labels"), F.col("f.unverified").alias("unverified"), F.col("f.ambiguous").alias("ambiguous"), F.lit(source).alias("source_id"), F.col("query_text").alias("query"), (F.size("f.labels") == 0).alias("clean"))


def label_problems(pairs: DataFrame) -> DataFrame:
    """(id, problem): labels (start, end, flag) that aren't 1 or reach out of the answer, and pairs with unverified ones."""
    bad = lambda x: ~((x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("answer")))
    each = F.concat(
        F.transform(F.filter("labels", lambda x: x["flag"] != 1), lambda x: F.concat(F.lit("flag "), x["flag"].cast("string"))),
        F.transform(F.filter("labels", bad), lambda x: F.concat(F.lit("bounds "), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))),
        F.transform(F.filter("labels", lambda x: ~bad(x) & (F.size("unverified") > 0)), lambda x: F.lit("unverified labels")))
    return pairs.select("id", F.explode(each).alias("problem"))


def resliced(pairs: DataFrame) -> DataFrame:
    """(id, wrong): labels (start, end, text) of pairs whose text isn't what the answer has there."""
    return pairs.select("id", F.size(F.filter("labels", lambda x: ~stands(F.col("answer"), x))).alias("wrong"))


def literal_of(documents: list[str]) -> str:
    """Documents as such files hold them."""
    return str([{"doc_text": d} for d in documents])


def annotation_of(spans: list[tuple[str, str | None]]) -> str:
    return json.dumps([{"span": s, "type": t} for s, t in spans], ensure_ascii=False)
