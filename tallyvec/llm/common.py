"""What the operators of this subpackage share: the shared folder, stage tables, Arrow loops."""

from __future__ import annotations

import contextlib
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at a time, and bytes of an Arrow batch.
CHUNK_BYTES, BATCH_BYTES = 4 << 20, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a temporary one in local mode, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own_dir()


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tallyvec-")


def stage_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage, survives lost executors.

    The tables stay until the folder is cleaned, since results are read from them later on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyvec/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark deletes shuffle files of a step when nothing refers to it any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage table that no later step reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, and BATCH_BYTES, for what is run inside: wide rows need small batches."""
    wanted = {"maxRecordsPerBatch": rows, "maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}", None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(f"spark.sql.execution.arrow.{k}", str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(f"spark.sql.execution.arrow.{k}")
            else:
                spark.conf.set(f"spark.sql.execution.arrow.{k}", v)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from here on in this session, for plans that run after their operator returned.

    Results don't depend on it; a bound that the session sets itself stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts whose lengths add up to about limit; a longer text stands alone."""
    i = total = 0
    for j, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(texts):
        yield i, len(texts)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function built once per task."""

    def run(batches):
        step = make()
        for b in batches:
            if b.num_rows:
                yield step(b)

    return df.mapInArrow(run, schema)
