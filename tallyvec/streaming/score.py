"""Scoring of unbounded sources: each micro-batch goes the way of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.staging import cleaned
from ..plans.engine import Engine


def score_stream(engine: Engine, payloads: DataFrame, key: str, path: str, checkpoint: str, value: str = "value", trigger: dict | None = None, leave_out_self: bool = False):
    """Start a query that scores a stream of payloads into Parquet, one folder a batch.

    Any streaming source will do that gives a key and a text (files, Kafka, sockets).  trigger is what
    DataStreamWriter.trigger takes; without it all that is there is scored and the query ends.
    A batch that is run again overwrites its own folder, so the sink holds every row once.
    """

    def write(batch: DataFrame, number: int) -> None:
        with cleaned(batch.sparkSession):
            engine.score(batch, key, value, leave_out_self).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
