"""Feature projection: parsed payload fields to 14 integer lanes (q0 to q13, ten-thousandths)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import SCALE, f32div, lane_names, mcc_risk, round_lane, unit_lane
from ..functions.payload import hour_of, monday_based_day

#: What each quantity is divided by.
MAX_AMOUNT, MAX_INSTALLMENTS, MAX_RATIO, MAX_MINUTES, MAX_KM, MAX_TX, MAX_MERCHANT_AVG = 10_000, 12, 10, 1440, 1000, 20, 10_000
DIMS = 14


def lanes() -> list[Column]:
    """Lane expressions over the columns of parse_payload."""
    c = F.col
    ratio = f32div(f32div(c("amount"), c("customer_avg_amount")), MAX_RATIO)
    last = lambda v: F.when(c("has_last_tx"), unit_lane(v)).otherwise(-SCALE)
    flag = lambda name: c(name).cast("int") * SCALE
    return [
        unit_lane(f32div(c("amount"), MAX_AMOUNT)),
        unit_lane(f32div(c("installments"), MAX_INSTALLMENTS)),
        F.when(c("customer_avg_amount") > 0, unit_lane(ratio)).otherwise(SCALE),
        round_lane(f32div(hour_of(c("requested_at")), 23)),
        round_lane(f32div(monday_based_day(c("requested_at")), 6)),
        last(f32div(c("minutes_since_last"), MAX_MINUTES)),
        last(f32div(c("km_from_current"), MAX_KM)),
        unit_lane(f32div(c("km_from_home"), MAX_KM)),
        unit_lane(f32div(c("tx_count_24h"), MAX_TX)),
        flag("is_online"),
        flag("card_present"),
        flag("is_unknown_merchant"),
        F.round(mcc_risk(c("mcc")) * SCALE),
        unit_lane(f32div(c("merchant_avg_amount"), MAX_MERCHANT_AVG)),
    ]


def vectorize(parsed: DataFrame) -> DataFrame:
    """parsed with lane columns; null lanes where the payload is invalid."""
    return parsed.withColumns({n: F.when(F.col("is_valid"), e).cast("bigint") for n, e in zip(lane_names(DIMS), lanes(), strict=True)})


def as_vector(df: DataFrame, dims: int = DIMS) -> DataFrame:
    """df with v, the lanes as an array of floats."""
    return df.withColumn("v", F.array(*[(F.col(n).cast("float") * F.lit(0.0001).cast("float")).cast("float") for n in lane_names(dims)]))
