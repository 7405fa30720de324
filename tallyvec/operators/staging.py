"""Tables written to the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one in local mode, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own_dir()


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tallyvec-")


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/tallyvec/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written once and read back."""
    path, schema = work_dir(df.sparkSession), df.schema
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def restaged(df: DataFrame, old: DataFrame) -> DataFrame:
    """df, which is made from the staged table old, written in its place: old is deleted."""
    out = staged(df)
    _delete(df.sparkSession, old._staged_at)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are deleted at the end: for steps that write out their results."""
    before = _written.set([])
    try:
        yield
    finally:
        for path in _written.get():
            _delete(spark, path)
        _written.reset(before)
