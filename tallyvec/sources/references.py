"""Labelled reference sets: JSON (also gzip) arrays of {vector, label} and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import explode_lanes

RECORD = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType())])


def read_references(spark: SparkSession, path: str, dims: int = 14) -> DataFrame:
    """ref_id (place in the file), q0..., label; wrong records are errors.  Other keys are skipped."""
    raw = spark.read.schema(RECORD).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ordered = raw.withColumn("ref_id", F.monotonically_increasing_id())  # one file is one task, in order
    return checked(ordered, dims).select("ref_id", *explode_lanes(F.col("vector").cast("array<float>"), dims), "label")


def checked(df: DataFrame, dims: int) -> DataFrame:
    """df with label as 0 or 1; raises where a vector or a label is wrong."""
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4028234663852886e38))
    vector = F.when(F.coalesce(good, F.lit(False)), v).otherwise(F.raise_error(F.lit(f"a vector isn't {dims} finite numbers")).cast(df.schema["vector"].dataType))
    label = F.when(F.col("label") == "fraud", 1).when(F.col("label") == "legit", 0).otherwise(F.raise_error(F.lit("a label is neither fraud nor legit")).cast("int"))
    return df.withColumn("vector", vector).withColumn("label", label)


def from_table(df: DataFrame, ref_id: str, vector: str, fraud, dims: int) -> DataFrame:
    """ref_id, q0..., label (1 where the condition fraud holds) of a table with an array column."""
    return df.select(F.col(ref_id).alias("ref_id"), *explode_lanes(F.col(vector), dims), fraud.cast("int").alias("label"))


def label_counts(refs: DataFrame) -> DataFrame:
    return refs.agg(F.sum((F.col("label") == 1).cast("bigint")).alias("fraud_count"), F.sum((F.col("label") == 0).cast("bigint")).alias("legit_count"), F.count(F.lit(1)).alias("n"))
