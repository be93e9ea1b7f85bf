"""Trained heads as expressions: linear models and boosted trees over feature columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logistic(names: list[str], means: list[float], scales: list[float], weights: list[float], bias: float) -> Column:
    """Probability of a linear model over standardised columns."""
    parts = (w * (F.col(n) - m) / (s or 1.0) for n, m, s, w in zip(names, means, scales, weights, strict=True))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(float(bias)))))


def tree(node: dict, names: list[str]) -> Column:
    """A decision tree ({"value"} or {"feature", "threshold", "left", "right"}); rows at most the threshold go left, compared as float32."""
    if "value" in node:
        return F.lit(float(node["value"]))
    at = F.col(names[node["feature"]]).cast("float") <= F.lit(float(node["threshold"]))
    return F.when(at, tree(node["left"], names)).otherwise(tree(node["right"], names))


def boosted(trees: list[dict], names: list[str], rate: float, start: float) -> Column:
    """Probability of a sum of trees."""
    total = reduce(lambda a, b: a + b, (rate * tree(t, names) for t in trees), F.lit(float(start)))
    return 1 / (1 + F.exp(-total))


def head_features(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Adds position, length and has_digit to token rows with the working features."""
    from pyspark.sql import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return rows.withColumns({"position": F.col("idx") / n, "length": F.least(F.lit(1.0), F.length("text") / 20.0), "has_digit": F.col("text").rlike(r"\p{Nd}").cast("double")}).select(key, "idx", *names, "position", "length", "has_digit")


def weight_grid(step: int, names: list[str]) -> list[dict[str, float]]:
    """All weights that are multiples of 1/step and add up to one."""

    def parts(total: int, count: int):
        if count == 1:
            yield (total,)
            return
        for i in range(total + 1):
            for rest in parts(total - i, count - 1):
                yield (i, *rest)

    return [{n: v / step for n, v in zip(names, p, strict=True)} for p in parts(step, len(names))]


def grid_auc(rows: DataFrame, label: str, names: list[str], step: int = 10, digits: int = 3) -> DataFrame:
    """(cell, weights..., auc) of every cell of the weight grid for risk = sum of weight * feature, best first.

    All cells are scored in one pass: rows are summed by cell and rounded risk before any ordering."""
    from plumbline.operators.metrics import auc

    cells = F.array(*(F.struct(F.lit(i).alias("cell"), *(F.lit(g[n]).alias(f"w_{n}") for n in names)) for i, g in enumerate(weight_grid(step, names))))
    spread = rows.select(label, *names, F.explode(cells).alias("g"))
    risk = reduce(lambda a, b: a + b, (F.col(f"g.w_{n}") * F.col(n) for n in names))
    scored = spread.select(label, F.col("g.cell").alias("cell"), F.round(risk, digits).alias("risk"))
    table = rows.sparkSession.createDataFrame([(i, *(g[n] for n in names)) for i, g in enumerate(weight_grid(step, names))], ["cell", *(f"w_{n}" for n in names)])
    return auc(scored, "risk", label, ["cell"]).join(F.broadcast(table), "cell").orderBy(F.col("auc").desc_nulls_last(), "cell")
