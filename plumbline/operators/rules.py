"""Rules over the numbers of answers: those that the context lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_numbers(pairs: DataFrame) -> DataFrame:
    """(pair_id, value, n): numbers of the answer that the context doesn't have."""
    number = lambda c: F.explode(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda x: F.translate(x, ",", ".")))
    said = pairs.select("pair_id", number(F.col("answer")).alias("value")).groupBy("pair_id", "value").agg(F.count(F.lit(1)).alias("n"))
    known = pairs.select("pair_id", number(F.col("context")).alias("value")).distinct()
    return said.join(known, ["pair_id", "value"], "left_anti")
