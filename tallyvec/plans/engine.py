"""The engine: load an index, score tables of payloads, score streams."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import lane_names
from ..functions.payload import parse_payload
from ..operators import decide, index, search
from ..operators.features import vectorize
from ..operators.staging import cleaned, staged


#: Payloads that warm-up alternates: a plain purchase and one without a history.
WARM_UP = [
    '{"id":"warm-a","transaction":{"amount":12.5,"installments":1,"requested_at":"2025-01-06T09:00:00Z"},"customer":{"avg_amount":20.0,"tx_count_24h":2,"known_merchants":["shop"]},"merchant":{"id":"shop","mcc":"5411","avg_amount":15.0},"terminal":{"is_online":false,"card_present":true,"km_from_home":1.0},"last_transaction":{"timestamp":"2025-01-06T08:00:00Z","km_from_current":0.5}}',
    '{"id":"warm-b","transaction":{"amount":4000.0,"installments":10,"requested_at":"2025-01-07T02:30:00Z"},"customer":{"avg_amount":0.0,"tx_count_24h":0,"known_merchants":[]},"merchant":{"id":"other","mcc":"7995","avg_amount":900.0},"terminal":{"is_online":true,"card_present":false,"km_from_home":700.0},"last_transaction":null}',
]


class Engine:
    """Holds an index; without one every payload is approved and ready() is false.

    A held index keeps its lists and statistics in the executors' memory and disk, and its centroids on
    the driver, between calls and micro-batches; blocks that are lost are read from the files again.
    """

    def __init__(self, found: index.Index | None = None, hold: bool = False):
        self.index, self.held = found, []
        if found is not None and hold:
            self.held = [found.lists.persist(StorageLevel.MEMORY_AND_DISK), found.stats.persist(StorageLevel.MEMORY_AND_DISK)]
            found.cells()

    @classmethod
    def load(cls, spark: SparkSession, path: str, config=None, hold: bool = True) -> Engine:
        try:
            return cls(index.load(spark, path, config), hold)
        except (FileNotFoundError, ValueError):
            return cls(None)

    def ready(self) -> bool:
        return self.index is not None

    def close(self) -> None:
        for held in self.held:
            held.unpersist()
        self.index, self.held = None, []

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def warm_up(self, spark: SparkSession) -> int:
        """Score warmup_rounds payloads, two by turns, as one table; the number that was scored."""
        if not self.ready() or not self.index.config.warmup_rounds:
            return 0
        turns = F.element_at(F.array(*map(F.lit, WARM_UP)), (F.col("id") % len(WARM_UP) + 1).cast("int"))
        rows = spark.range(self.index.config.warmup_rounds).withColumn("value", turns)
        with cleaned(spark):
            return self.score(rows, "id").filter("status = 'ok'").count()

    def score(self, payloads: DataFrame, key: str, value: str = "value", leave_out_self: bool = False) -> DataFrame:
        """key, status, fraud_count, fraud_score, approved, body for every row (key must be unique).

        leave_out_self: the keys are those of the reference rows, and a row isn't its own neighbour.
        """
        asked = payloads.select(F.col(key).alias("__key"), F.col(value).alias("value"))  # the payload has an id of its own
        if not self.ready():
            rows = asked.select(F.col("__key").alias(key), F.lit("not_ready").alias("status"), F.lit(0).cast("bigint").alias("fraud_count"))
            return decide.decide(rows)
        c = self.index.config
        rows = vectorize(parse_payload(asked))
        # payloads are parsed once: what is written has the probes of the valid ones and a row without a probe for any other
        probed = staged(search.probes(rows.select(F.col("__key").alias("qid"), *lane_names(c.dims)), self.index.cells(), c.dims, c.nprobe_full))
        probed = search.first_found(probed, self.index, leave_out_self)
        counts = search.probed_counts(probed.filter("probe is not null"), self.index, leave_out_self)
        wrong = probed.filter("probe is null").select(F.col("qid").alias(key), F.lit("parse_error").alias("status"), F.lit(0).cast("bigint").alias("fraud_count"))
        out = counts.select(F.col("qid").alias(key), F.lit("ok").alias("status"), "fraud_count").unionByName(wrong)
        return decide.decide(out, c.threshold)
