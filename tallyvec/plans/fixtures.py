"""Tables that the queries run on: vectors of embeddings and payloads made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.references import from_table

DIMS, K = 64, 16
#: Categories that events are mapped to: the known ones and one that has no risk of its own.
CODES = ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "1234"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def embedding_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, q0 to q63, label (1 for classes below five)."""
    return from_table(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label") < 5, DIMS)


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a payload holds, from events: previous events of the user are its history."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    rows = e.select("event_id", "user_id", "event_type", "ts", k.alias("k"), (k % 20).alias("m"), cents.alias("cents"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    user = Window.partitionBy("user_id")
    in_order = user.orderBy("ts", "event_id")
    day = user.orderBy("us").rangeBetween(-86_400_000_000, -1)
    rows = rows.withColumns({
        "avg_amount": F.when(F.col("event_id") % 97 == 0, 0.0).otherwise(F.sum("cents").over(user) / F.count(F.lit(1)).over(user) / 10.0),
        "tx_count_24h": F.count(F.lit(1)).over(day),
        "known": F.collect_list(F.concat(F.lit("M-"), F.col("m"))).over(in_order.rowsBetween(-3, -1)),
        "last_ts": F.lag("ts").over(in_order),
    })
    shops = rows.groupBy("m").agg((F.sum("cents") / F.count(F.lit(1)) / 10.0).alias("shop_avg"))  # 20 rows
    return rows.join(F.broadcast(shops), "m")


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, value (JSON text), label."""
    c, iso = F.col, "yyyy-MM-dd'T'HH:mm:ss'Z'"
    last = F.struct(F.date_format("last_ts", iso).alias("timestamp"), (c("event_id") * 53 % 9000 / 10.0).alias("km_from_current"))
    body = F.struct(
        F.concat(F.lit("tx-"), c("event_id")).alias("id"),
        F.struct((c("cents") / 10.0).alias("amount"), (c("event_id") % 15).alias("installments"), F.date_format("ts", iso).alias("requested_at")).alias("transaction"),
        F.struct(c("avg_amount"), c("tx_count_24h"), c("known").alias("known_merchants")).alias("customer"),
        F.struct(F.concat(F.lit("M-"), c("m")).alias("id"), F.element_at(F.array(*map(F.lit, CODES)), c("k") % 11 + 1).alias("mcc"), c("shop_avg").alias("avg_amount")).alias("merchant"),
        F.struct((c("event_id") % 3 == 0).alias("is_online"), (c("event_id") % 2 == 0).alias("card_present"), (c("event_id") * 37 % 12000 / 10.0).alias("km_from_home")).alias("terminal"),
        F.when(c("last_ts").isNotNull(), last).alias("last_transaction"),
    )
    return event_fields(spark, sf_dir).select("event_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"), c("event_type").isin("error", "signup").cast("int").alias("label"))


#: The same tables in DuckDB's SQL.
def _lane(x: str) -> str:
    return f"CAST(sign(CAST({x} AS DOUBLE)) * floor(abs(CAST({x} AS DOUBLE)) + 0.5) AS BIGINT)"


def _unit(v: str) -> str:
    return f"CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= 1 THEN 10000 ELSE {_lane(f'({v}) * 10000::FLOAT')} END"


EMB = "e AS (SELECT vec_id AS ref_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, " + ", ".join(f"{_lane(f'embedding[{i + 1}] * 10000::FLOAT')} AS q{i}" for i in range(DIMS)) + " FROM embeddings)"
_codes = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
EV = f"""ev0 AS (SELECT event_id, user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, epoch_us(ts) AS us FROM events),
ev1 AS (SELECT *, k % 20 AS m,
    CASE WHEN event_id % 97 = 0 THEN 0.0::DOUBLE ELSE CAST(sum(cents) OVER (PARTITION BY user_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id) / 10.0::DOUBLE END AS avg_amount,
    count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS tx_count_24h,
    list(k % 20) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS known,
    lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_ts FROM ev0),
ev2 AS (SELECT ev1.*, shop_avg, {_codes}[k % 11 + 1] AS mcc,
    CASE WHEN last_ts IS NULL THEN 0 ELSE greatest(0, floor(epoch(date_trunc('second', ts)) / 60) - floor(epoch(date_trunc('second', last_ts)) / 60)) END::BIGINT AS minutes,
    NOT coalesce(list_contains(known, m), FALSE) AS unknown
    FROM ev1 JOIN (SELECT k % 20 AS sm, CAST(sum(cents) AS DOUBLE) / count(*) / 10.0::DOUBLE AS shop_avg FROM ev0 GROUP BY 1) s ON m = sm),
f AS (SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS label,
    {_unit("CAST(cents / 10.0::DOUBLE AS FLOAT) / 10000::FLOAT")} AS q0, {_unit("CAST(least(event_id % 15, 12) AS FLOAT) / 12::FLOAT")} AS q1,
    CASE WHEN CAST(avg_amount AS FLOAT) > 0 THEN {_unit("CAST(cents / 10.0::DOUBLE AS FLOAT) / CAST(avg_amount AS FLOAT) / 10::FLOAT")} ELSE 10000 END AS q2,
    {_lane("CAST(hour(ts) AS FLOAT) / 23::FLOAT * 10000::FLOAT")} AS q3, {_lane("CAST(isodow(ts) - 1 AS FLOAT) / 6::FLOAT * 10000::FLOAT")} AS q4,
    CASE WHEN last_ts IS NULL THEN -10000 ELSE {_unit("CAST(minutes AS FLOAT) / 1440::FLOAT")} END AS q5,
    CASE WHEN last_ts IS NULL THEN -10000 ELSE {_unit("CAST((event_id * 53 % 9000) / 10.0::DOUBLE AS FLOAT) / 1000::FLOAT")} END AS q6,
    {_unit("CAST((event_id * 37 % 12000) / 10.0::DOUBLE AS FLOAT) / 1000::FLOAT")} AS q7, {_unit("CAST(least(tx_count_24h, 20) AS FLOAT) / 20::FLOAT")} AS q8,
    CASE WHEN event_id % 3 = 0 THEN 10000 ELSE 0 END AS q9, CASE WHEN event_id % 2 = 0 THEN 10000 ELSE 0 END AS q10, CASE WHEN unknown THEN 10000 ELSE 0 END AS q11,
    CASE mcc WHEN '5411' THEN 1500 WHEN '5812' THEN 3000 WHEN '5912' THEN 2000 WHEN '5944' THEN 4500 WHEN '7801' THEN 8000 WHEN '7802' THEN 7500 WHEN '7995' THEN 8500 WHEN '4511' THEN 3500 WHEN '5311' THEN 2500 ELSE 5000 END AS q12,
    {_unit("CAST(shop_avg AS FLOAT) / 10000::FLOAT")} AS q13 FROM ev2)"""
