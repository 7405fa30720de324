"""build-index, score and stream, for spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import index
from .operators.staging import cleaned
from .plans.config import EngineConfig
from .plans.engine import Engine
from .sources.references import read_references
from .streaming.score import score_stream


def parser() -> argparse.ArgumentParser:
    number = lambda s: int(s, 0)
    p = argparse.ArgumentParser(prog="tallyvec")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build-index")
    b.add_argument("input")
    b.add_argument("output")
    for name in ("k", "iterations", "sample", "seed"):
        b.add_argument(f"--{name}", type=number, default=getattr(EngineConfig, name))
    s = sub.add_parser("score")
    s.add_argument("index")
    s.add_argument("input", help="text file, a payload a line")
    s.add_argument("output")
    t = sub.add_parser("stream")
    t.add_argument("index")
    t.add_argument("output")
    t.add_argument("checkpoint")
    t.add_argument("--format", default="text", help="streaming source, e.g. text, kafka, socket")
    t.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="of the source, e.g. path=... or subscribe=...")
    t.add_argument("--every", help="time between batches, e.g. '5 seconds'; else what is there is scored once")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "build-index":
        config = EngineConfig(k=a.k, iterations=a.iterations, sample=a.sample, seed=a.seed)
        with cleaned(spark):
            built = index.build(read_references(spark, a.input), config)
            index.save(built, a.output)
        print(index.list_stats(index.load(spark, a.output).stats).first().asDict())
    elif a.command == "stream":
        source = spark.readStream.format(a.format).options(**dict(x.split("=", 1) for x in a.option)).load()
        rows = source.select(F.col("value").cast("string").alias("value")).withColumn("id", F.expr("uuid()"))
        engine = Engine.load(spark, a.index, EngineConfig.from_env())
        engine.warm_up(spark)
        score_stream(engine, rows, "id", a.output, a.checkpoint, trigger={"processingTime": a.every} if a.every else None).awaitTermination()
    else:
        rows = spark.read.text(a.input).withColumn("row", F.monotonically_increasing_id())
        with cleaned(spark):
            Engine.load(spark, a.index).score(rows, "row").write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
