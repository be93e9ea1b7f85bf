"""Verification of a stream of pairs, micro-batch by micro-batch.

A verdict needs its own pair only, so there is no state and no watermark: every batch
runs the batch plan, and a replayed batch replaces its own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.verify import verify


def pair_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(pair_id, context, answer) of JSON-lines files as they arrive."""
    return spark.readStream.schema("pair_id string, context string, answer string").option("maxFilesPerTrigger", files_per_batch).json(path)


def verify_stream(pairs: DataFrame, out: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Verdicts of a stream as Parquet, one folder a batch."""

    def run(batch: DataFrame, number: int) -> None:
        verify(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pairs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
