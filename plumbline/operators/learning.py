"""Linear models fitted by gradient descent in Spark: a pass of the rows for each epoch, sums of gradients to the driver."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.functions import text as tx
from plumbline.operators import metrics as mt
from plumbline.scratch import dropped, written


@dataclass(frozen=True)
class Linear:
    """A logistic model over standardised columns."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self) -> Column:
        """The probability of a row."""
        parts = (w * (F.col(n) - m) / s for n, m, s, w in zip(self.names, self.means, self.scales, self.weights, strict=True))
        score = reduce(lambda a, b: a + b, parts, F.lit(float(self.bias)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Linear:
        out = cls(*(tuple(values[k]) for k in ("names", "means", "scales", "weights")), float(values["bias"]))
        if len({len(out.names), len(out.means), len(out.scales), len(out.weights)}) != 1 or min(out.scales, default=1.0) <= 0:
            raise ValueError("a linear model needs a mean, a positive scale and a weight for every name")
        return out


def standard(rows: DataFrame, names: list[str], sample: bool = False) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Means and scales (population or sample deviation, 1 for none) of the columns, in one pass."""
    spread = F.stddev_samp if sample else F.stddev_pop
    r = rows.agg(*(F.avg(n).alias(f"m{i}") for i, n in enumerate(names)), *(spread(n).alias(f"s{i}") for i, n in enumerate(names))).first()
    k = len(names)
    return tuple(float(r[i] or 0.0) for i in range(k)), tuple(float(r[k + i] or 0.0) or 1.0 for i in range(k))


def logistic(rows: DataFrame, names: list[str], label: str, *, epochs: int = 400, rate: float = 0.5, l2: float = 1e-3, balanced: bool = False, sample: bool = False) -> Linear:
    """A model of a 0/1 label by full-batch gradient descent from zero.

    Equal rows are summed first, so an epoch passes over the distinct ones. balanced
    weighs both classes alike. Without rows, all weights are zero."""
    means, scales = standard(rows, names, sample)
    held = written(rows.select(*(F.col(n).cast("double").alias(n) for n in names), (F.col(label) == 1).cast("double").alias("y")).groupBy(*names, "y").agg(F.count(F.lit(1)).cast("double").alias("n")), "rows")
    count = {r["y"]: r["n"] for r in held.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    total = sum(count.values())
    weigh = {y: total / (len(count) * n) if balanced else 1.0 for y, n in count.items()}
    weight = F.col("n") * F.when(F.col("y") == 1, weigh.get(1.0, 1.0)).otherwise(weigh.get(0.0, 1.0))
    model = Linear(tuple(names), means, scales, (0.0,) * len(names), 0.0)
    for _ in range(epochs if total else 0):
        error = (model.column() - F.col("y")) * weight
        sums = held.agg(F.sum(error), *(F.sum(error * (F.col(n) - m) / s) for n, m, s in zip(names, means, scales, strict=True))).first()
        weights = tuple(w - rate * (g / total + l2 * w) for w, g in zip(model.weights, sums[1:], strict=True))
        model = Linear(model.names, means, scales, weights, model.bias - rate * sums[0] / total)
    dropped(held)
    return model


def out_of_fold(rows: DataFrame, names: list[str], label: str, fold: str, folds: int, **options) -> DataFrame:
    """rows with probability: each fold scored by a model of the others."""
    parts = []
    for k in range(folds):
        model = logistic(rows.where(F.col(fold) != k), names, label, **options)
        parts.append(rows.where(F.col(fold) == k).withColumn("probability", model.column()))
    return reduce(lambda a, b: a.unionByName(b), parts)


def fold_receipts(rows: DataFrame, group: str, fold: str) -> DataFrame:
    """(fold, n, groups, digest) of what each fold holds out; fails if a group is in two folds."""
    torn = rows.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")
    if not torn.isEmpty():
        raise ValueError(f"a {group} is in more than one fold")
    held = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups"), F.sha2(F.array_join(F.sort_array(F.collect_set(F.col(group).cast("string"))), ","), 256).alias("digest"))
    return held.select(F.col(fold).alias("fold"), "n", "groups", "digest")


def out_of_fold_auc(rows: DataFrame, names: list[str], label: str, fold: str, folds: int, **options) -> DataFrame:
    return mt.auc(out_of_fold(rows, names, label, fold, folds, **options), "probability", label)


HEAD = [*lex.WEIGHTS, "combined"]


def head_rows(risks: DataFrame) -> DataFrame:
    """Scored tokens with the six columns that a token head judges: the working features and their combination."""
    return risks.where("scored").withColumn("combined", F.col("risk"))


def token_samples(risks: DataFrame, spans: DataFrame) -> DataFrame:
    """Scored tokens as training rows: features, place, total, and label 1 where a marked span overlaps them."""
    from pyspark.sql import Window as W

    from plumbline.operators.spans import labelled

    rows = risks.withColumn("total", F.count(F.lit(1)).over(W.partitionBy("pair_id"))).where("scored")
    return labelled(rows, spans, "pair_id").select("pair_id", "idx", "total", "text", *lex.WEIGHTS, "risk", "label", "start", "end")


PARTICIPATION = ["entropy", "mass", "density", "cliche", "length"]


def participation_rows(features: DataFrame, answers: DataFrame) -> DataFrame:
    """Scored tokens with PARTICIPATION: three features, and how full of set phrases and how long their sentence is."""
    parts = tx.sentences(answers, ["pair_id"], "answer").select(F.col("pair_id").alias("of"), F.col("text").alias("sentence"), F.col("start").alias("s"), F.col("end").alias("e"))
    hits = F.size(F.filter(F.array(*map(F.lit, lex.MACHINE_CLICHES)), lambda c: F.contains(F.lower("sentence"), c)))
    parts = parts.select("of", "s", "e", F.least(F.lit(1.0), hits / 2).alias("cliche"), F.least(F.lit(1.0), F.length("sentence") / 120).alias("length"))
    toks = features.where("scored").drop("length")
    return toks.join(parts, (F.col("pair_id") == F.col("of")) & (F.col("s") <= F.col("start")) & (F.col("start") < F.col("e"))).drop("of", "s", "e")


def participation(rows: DataFrame, model: Linear) -> DataFrame:
    """(pair_id, ai_participation): the mean probability of a pair's tokens."""
    return rows.groupBy("pair_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(model.column()))).alias("ai_participation"))
