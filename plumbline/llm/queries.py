"""The queries of the ten operators over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.chat import chats, digests, records_of_turns
from plumbline.llm.decontamination import leaks
from plumbline.llm.html_text import extracted
from plumbline.llm.licenses import scanned
from plumbline.llm.line_dedup import line_dedup_sql, without_boilerplate
from plumbline.llm.mixing import mixed_sources, mixing_sql
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.passages import repeated_passages
from plumbline.llm.quality import judged, quality_sql
from plumbline.llm.toxicity import learned, scored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the host."""
    docs = table(spark, sf_dir, "documents")
    return without_boilerplate(docs, host="source", text="text", counts=True).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a conversation -7 whose texts hold control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(chats(records_of_turns(turns.unionByName(more))))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("detections")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learned(docs, table(spark, sf_dir, "labels")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_decontamination": op5_decontamination,
    "op6_passages": op6_passages,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_html": op9_html,
    "op10_mixing": op10_mixing,
}

SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup_sql(),
    "op3_quality": quality_sql(),
    "op10_mixing": mixing_sql(),
}
