"""What substring dedup leaves on disk on its way."""

import random
from pathlib import Path

import plumbline.llm.passages as passages


def shuffle_files(spark):
    """Shuffle files of the session, on disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(p) for d in folders for p in Path(d).rglob("shuffle_*.data")}


def test_seeds_and_texts_are_not_kept(spark, monkeypatch):
    """No table of seeds, no shuffle files of seeds and texts once they were used, and texts meet what asks for them by one plan at any size."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = text(60)
    docs = [(i, " ".join(text(50) + shared + text(50))) for i in range(40)]
    plans, left, write = {}, {}, passages.written

    def noted(df, name):
        before = shuffle_files(spark)
        out = write(df, name)
        plans[name], left[name] = df._jdf.queryExecution().executedPlan().toString(), shuffle_files(spark) - before
        return out

    monkeypatch.setattr(passages, "written", noted)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {(r["doc_id"], r["other_doc"]) for r in passages.repeated_passages(rows).collect() if r["n_words"] >= 50} == {(i, 0) for i in range(1, 40)}
    assert "seeds" not in plans and left["chains"] == left["passages"] == set()
    met = [line for line in plans["passages"].split("\n") if "[asked#" in line and "Join" in line]
    assert met and not any("Broadcast" in line for line in met)
