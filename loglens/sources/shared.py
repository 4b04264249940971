"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so there the setting is required.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="loglens-"))
    return context.getCheckpointDir().rstrip("/")


# Paths handed out by this process.
_paths: list[str] = []

# A folder that has an owner of its own, for the tables made in a ``tables_in`` block.
_owned: ContextVar[str | None] = ContextVar("owned", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    if _owned.get():
        return f"{_owned.get()}/{name}-{uuid.uuid4().hex}"
    _paths.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


@contextmanager
def tables_in(folder: str) -> Iterator[None]:
    """Intermediate tables of the block go to ``folder``, which its owner deletes."""
    before = _owned.set(folder)
    try:
        yield
    finally:
        _owned.reset(before)


def delete(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; results built on them end with them."""
    while _paths:
        delete(spark, _paths.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    The result no longer depends on the lineage above it, and Catalyst knows its size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
