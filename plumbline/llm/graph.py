"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); label is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, shortens the chains by
    pointer jumping and contracts the edges to what still joins two labels. Stars
    end after one round, long chains after a number of rounds that is logarithmic
    in their length. All tables stay distributed; hot nodes are pre-aggregated (the
    minimum) and appear in joins only against a side with one row per node, so a
    skewed side can be split. Without edges the result is empty."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "hooks")
        while True:
            step = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = written(hooks.join(step, "label").select("node", "label", "next"), "jumps")
            done = jumped.where("next <> label").isEmpty()
            dropped(hooks)
            hooks = jumped.select("node", F.col("next").alias("label"))
            hooks.scratch_path = jumped.scratch_path
            if done:
                break
        to = hooks.select(F.col("node"), F.col("label").alias("to"))
        left = edges.join(to.withColumnRenamed("node", "a"), "a").withColumnRenamed("to", "p")
        left = left.join(to.withColumnRenamed("node", "b"), "b").withColumnRenamed("to", "q").where("p <> q")
        fewer = written(left.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct(), "edges")
        if total is None:
            total = written(hooks, "labels")
        else:
            moved = total.join(to.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            total, old = written(moved, "labels"), total
            dropped(old)
        dropped(hooks)
        dropped(edges)
        edges = fewer
    if total is None:
        total = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return total
