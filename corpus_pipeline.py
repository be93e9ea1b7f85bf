"""The corpus pipeline: five stages, each applied to all that its predecessor kept.

For all stages: a row of null id or text is a row like others and stays unless the
operator's own rule takes it out; empty and blank texts are neither toxic nor copies
nor leaks; repeated rows share their fate, but for near-dedup, where rows of one id are
one document; an empty table gives an empty one; columns beyond those of documents go
through whatever their names. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import dropped, finished
from plumbline.llm.decontamination import without_leaks
from plumbline.llm.line_dedup import without_boilerplate
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.near_dedup import without_near_duplicates
from plumbline.llm.toxicity import learned, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity score is 0.7 or more."""
    return without_toxic(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows the text."""
    out = without_boilerplate(docs, host="source", text="text")
    return out.selectExpr(*(f"cast(length(text) as {dict(docs.dtypes)[c]}) as {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return without_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents to train on, with their texts, a row for each epoch that takes them."""
    return mixed_documents(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: A learned model, components and fingerprints are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage read is then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = finished(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return docs
