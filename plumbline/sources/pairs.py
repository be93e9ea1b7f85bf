"""Pairs of a context and an answer: reading, checking, deriving and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TEXT = 2_000_000

#: The columns of a pair. Labels are half-open code-point offsets into the answer with a flag.
PAIR = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("labels", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)
KEYS = [f.name for f in PAIR]


def read_pairs(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Pairs of JSON-lines files, with reasons (what is wrong with a row) unless strict, which fails on the first bad row.

    Blank lines are skipped. The line itself is kept until it is checked, so unknown
    keys and wrong types are found rather than dropped."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    broken = "broken"
    schema = T.StructType([*PAIR.fields, T.StructField(broken, T.StringType())])
    rows = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}).alias("r"), F.json_object_keys("value").alias("keys"))
    rows = rows.select("value", "r.*", "keys")
    unknown = F.array_except("keys", F.array(*map(F.lit, KEYS)))
    checked = rows.withColumn(
        "reasons",
        F.concat(
            F.array_compact(
                F.array(
                    F.when(F.col("keys").isNull() | F.col(broken).isNotNull(), "not a JSON object of the expected types"),
                    F.when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.sort_array(unknown), ", "))),
                )
            ),
            problems(),
        ),
    )
    if strict:
        bad = F.concat(F.lit("bad pair: "), F.array_join("reasons", "; "), F.lit(" in "), F.substring("value", 1, 200))
        return checked.select(*(F.when(F.size("reasons") > 0, F.raise_error(bad).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in PAIR))
    return checked.select(*KEYS, "reasons")


def problems() -> Column:
    """What is wrong with a pair's columns, all reasons at once."""
    answer = F.coalesce(F.length("answer"), F.lit(0))
    bad = lambda x: (F.size(x) != 3) | (F.get(x, F.lit(0)) < 0) | (F.get(x, F.lit(1)) < F.get(x, F.lit(0))) | (F.get(x, F.lit(1)) > answer) | ~F.get(x, F.lit(2)).isin(0, 1)
    return F.array_compact(
        F.array(
            F.when(F.col("context").isNull(), "context is missing"),
            F.when(F.col("answer").isNull(), "answer is missing"),
            F.when(F.coalesce(F.exists("labels", lambda x: F.coalesce(bad(x), F.lit(True))), F.lit(False)), "labels must be [start, end, 0 or 1] within the answer"),
            F.when((F.length("context") > MAX_TEXT) | (answer > MAX_TEXT), f"a text is longer than {MAX_TEXT} characters"),
        )
    )


def write_pairs(pairs: DataFrame, path: str) -> None:
    """JSON lines with the columns of a pair."""
    pairs.select(*KEYS).write.mode("overwrite").json(path)


def pairs_of_conversations(conversations: DataFrame) -> DataFrame:
    """(pair_id, context, answer): every user turn with the assistant's next turn."""
    asked = conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    said = conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "context", "answer")


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as when later lines replace earlier ones."""
    best = F.max_by(F.struct(*rows.columns), F.col(order))
    return rows.groupBy(key).agg(best.alias("r")).select("r.*")


def rebuilt(parts: DataFrame) -> DataFrame:
    """(name, payload, complete) of chunked payloads (name, idx, payload): chunks in order, complete if 0..n-1 are there."""
    held = parts.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("idx", "payload"))).alias("p"))
    complete = F.transform("p", lambda x: x["idx"]) == F.sequence(F.lit(0), F.size("p") - 1)
    return held.select("name", F.array_join(F.transform("p", lambda x: x["payload"]), "").alias("payload"), complete.alias("complete"))
