"""Commands: verify, tokens, features, evaluate, train, calibrate, selftest.

python -m plumbline.cli verify pairs.jsonl --out verdicts
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import cases
from plumbline.operators import features as ft
from plumbline.plans import training
from plumbline.plans import verify as vf
from plumbline.sources import files
from plumbline.sources.pairs import read_pairs

#: Pairs of the self-test and the verdicts that they may have.
EXPECTED = {"p1": {"grounded"}, "p2": {"doubtful", "likely_hallucination"}, "p3": {"doubtful", "likely_hallucination"}, "p6": {"doubtful", "likely_hallucination"}, "p9": {"empty"}}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="plumbline")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("verify", "tokens", "features", "evaluate", "train", "calibrate"):
        c = commands.add_parser(name)
        c.add_argument("pairs", help="JSON lines with id, context, answer and labels")
        c.add_argument("--settings", help="a file of settings")
        c.add_argument("--out", help="folder to write to; rows are shown without it")
    commands.add_parser("selftest")
    return out


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """Pairs by pair_id; lines without an id get their place."""
    rows = read_pairs(spark, path)
    return rows.select(F.coalesce("id", F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string"))).alias("pair_id"), "context", "answer", F.coalesce("labels", F.array()).alias("labels"))


def selftest(spark: SparkSession) -> list[str]:
    """What the typed-in pairs are judged against what is expected; nothing if all is well."""
    got = {r["pair_id"]: r["verdict"] for r in vf.verified(cases.pairs(spark)).select("pair_id", "verdict").collect()}
    return [f"{p}: {got.get(p)} instead of {' or '.join(sorted(want))}" for p, want in EXPECTED.items() if got.get(p) not in want]


def result(spark: SparkSession, command: str, pairs: DataFrame, settings: files.Settings) -> DataFrame:
    if command == "verify":
        return vf.verified(pairs, threshold=settings.threshold, rule=settings.rule, params=settings.rule_params, expansion=settings.expansion, least_chars=settings.least_chars)
    if command == "tokens":
        return training.payload(pairs, settings)
    if command == "features":
        return files.feature_rows(ft.token_features(pairs), pairs)
    if command == "evaluate":
        return training.evaluated(pairs, settings)
    if command == "train":
        from dataclasses import asdict

        return spark.createDataFrame([(json.dumps(asdict(training.trained(pairs)), ensure_ascii=False),)], "value string")
    steps = training.calibrated(pairs, settings)
    return spark.createDataFrame(list(zip(steps.uppers, steps.values, strict=True)), "upper double, value double")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    if args.command == "selftest":
        problems = selftest(spark)
        print("\n".join(problems) or "ok")
        return 1 if problems else 0
    settings = files.read_settings(spark, args.settings) if args.settings else files.Settings()
    out = result(spark, args.command, loaded(spark, args.pairs), settings)
    if args.out:
        out.write.mode("overwrite").json(args.out)
    else:
        out.show(50, truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main())
