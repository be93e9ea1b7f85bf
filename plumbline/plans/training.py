"""Settings learned from labelled pairs, and the quality of a verification on them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import lexicon as lex
from plumbline.operators import calibration, evaluation, heads
from plumbline.operators import features as ft
from plumbline.operators import metrics as mt
from plumbline.operators import shaping as sh
from plumbline.operators.spans import labelled
from plumbline.plans import verify as vf
from plumbline.scratch import dropped, written
from plumbline.sources.files import Settings


def marked(pairs: DataFrame) -> DataFrame:
    """(pair_id, start, end) of the labels [start, end, 1] of pairs."""
    rows = pairs.select("pair_id", F.explode("labels").alias("l")).where(F.col("l")[2] == 1)
    return rows.select("pair_id", F.col("l")[0].alias("start"), F.col("l")[1].alias("end"))


def judged(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Scored tokens of labelled pairs with flagged and label."""
    rows = vf.spanned(vf.token_risks(pairs, settings.weights), settings.span_z, settings.span_floor, settings.span_cap)
    return labelled(rows.where("scored"), marked(pairs), "pair_id")


def evaluated(pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(level, tp, fp, fn, tn, precision, recall, f1, fpr, accuracy) of tokens, answers (score against threshold) and verdicts on labelled pairs.

    An answer counts as wrong if any of its labels is 1."""
    settings = settings or Settings()
    tokens = written(judged(pairs, settings), "judged")
    truth = pairs.select("pair_id", F.exists("labels", lambda x: x[2] == 1).cast("int").alias("y"))
    found = vf.verified(pairs.select("pair_id", "context", "answer"), threshold=settings.threshold, rule=settings.rule, params=settings.rule_params, expansion=settings.expansion, least_chars=settings.least_chars)
    answers = written(found.join(truth, "pair_id").select("y", "is_hallucination", (~F.col("verdict").isin("grounded", "empty")).alias("doubted")), "answers")
    rows = tokens.select(F.lit("token").alias("level"), F.col("label").alias("y"), F.col("flagged").alias("said"))
    rows = rows.unionByName(answers.select(F.lit("answer").alias("level"), "y", F.col("is_hallucination").alias("said"))).unionByName(answers.select(F.lit("verdict").alias("level"), "y", F.col("doubted").alias("said")))
    return mt.confusion(rows, F.col("y"), F.col("said"), ["level"])


def span_quality(pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Precision, recall and f1 of the verification's spans by IoU, against the labels of pairs."""
    settings = settings or Settings()
    rows = written(vf.spanned(vf.token_risks(pairs, settings.weights), settings.span_z, settings.span_floor, settings.span_cap), "tokens")
    return mt.span_f1(vf.result_spans(pairs, rows, settings.expansion, settings.least_chars), marked(pairs), "pair_id")


def trained(pairs: DataFrame, *, step: int = 10, max_fpr: float = 0.4) -> Settings:
    """Settings learned from labelled pairs: weights of best AUC of the grid, then the mask's three parameters, then the answers' threshold.

    The mask is the one of best f1 with fpr within max_fpr, the threshold likewise; the
    defaults stay where no cell is within it. A cell of the grids costs sums, not a pass."""
    rows = ft.token_features(pairs).where("scored")
    # The grid weighs what lacks to full support, as the risk does.
    rows = rows.withColumns({n: 1 - F.col(n) for n in lex.WEIGHTS if n != "entropy"})
    rows = written(labelled(rows, marked(pairs), "pair_id"), "features")
    best = heads.grid_auc(rows, "label", list(lex.WEIGHTS), step=step).first()
    dropped(rows)
    settings = Settings()
    if best is not None and best["auc"] is not None:
        settings = replace(settings, weights={n: float(best[f"w_{n}"]) for n in lex.WEIGHTS})
    risks = written(vf.token_risks(pairs, settings.weights), "risks")
    cells = evaluation.mask_grid(labelled(risks.where("scored"), marked(pairs), "pair_id"), "label").where(F.col("fpr") <= max_fpr)
    cell = cells.orderBy(F.col("f1").desc(), "fpr", F.col("recall").desc(), "z", "floor", "cap").first()
    if cell is not None:
        settings = replace(settings, span_z=cell["z"], span_floor=cell["floor"], span_cap=cell["cap"])
    truth = pairs.select("pair_id", F.exists("labels", lambda x: x[2] == 1).cast("int").alias("y"))
    scores = vf.answer_scores(risks).join(truth, "pair_id").withColumn("score", F.round("score", 9))
    limit = mt.best_threshold(scores, "score", "y", max_fpr).first()
    return settings if limit is None else replace(settings, threshold=float(limit["threshold"]))


def calibrated(pairs: DataFrame, settings: Settings | None = None, digits: int = 6) -> calibration.Steps:
    """Monotone steps from answer scores to the share of wrong answers."""
    settings = settings or Settings()
    truth = pairs.select("pair_id", F.exists("labels", lambda x: x[2] == 1).cast("int").alias("y"))
    scores = vf.answer_scores(vf.token_risks(pairs, settings.weights)).join(truth, "pair_id")
    return calibration.isotonic(scores, "score", "y", digits)


def payload(pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Token rows of the output for every pair."""
    settings = settings or Settings()
    return sh.token_payload(vf.spanned(vf.token_risks(pairs, settings.weights), settings.span_z, settings.span_floor, settings.span_cap))
