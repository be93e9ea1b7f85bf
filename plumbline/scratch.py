"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or (only where unset, in local mode) a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_folder, "own", None)
        if base is None:
            own = tempfile.mkdtemp(prefix="plumbline-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = shared_folder.own = "file://" + own
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    The copy survives lost executors and is never computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Each query that runs within deletes its shuffle files when it ends; the caller's setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def deleted(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    deleted(df.sparkSession, df.scratch_path)


#: Paths written within each scope under way, the innermost last.
_scopes: list[list[str]] = []


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows, written; every other table that was written on the way is deleted, so nothing lazy of it may be used."""
    _scopes.append([])
    try:
        out = written(make(), name)
    finally:
        paths = _scopes.pop()
    for path in paths:
        if path != out.scratch_path:
            deleted(out.sparkSession, path)
    if _scopes:
        _scopes[-1].append(out.scratch_path)
    return out
