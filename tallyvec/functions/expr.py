"""Column builders for single-precision arithmetic, quantised lanes and distances."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Risk by merchant category; any other category has the last.
MCC_RISK = {5411: 0.15, 5812: 0.30, 5912: 0.20, 5944: 0.45, 7801: 0.80, 7802: 0.75, 7995: 0.85, 4511: 0.35, 5311: 0.25, 5999: 0.50}
OTHER_RISK = 0.50
SCALE = 10_000


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def f32div(a, b) -> Column:
    """Single-precision quotient (Spark divides floats as doubles)."""
    return (f32(a) / f32(b)).cast("float")


def round_lane(v: Column) -> Column:
    """v * 10000 in single precision, rounded half away from zero."""
    scaled = (f32(v) * f32(SCALE)).cast("double")
    return (F.sign(scaled) * F.floor(F.abs(scaled) + 0.5)).cast("bigint")


def unit_lane(v: Column) -> Column:
    """Lane of v clamped to 0..1."""
    inside = F.floor((f32(v) * f32(SCALE)).cast("double") + 0.5)  # round_lane of what is above 0
    return F.when(v <= 0, F.lit(0)).when(v >= 1, F.lit(SCALE)).otherwise(inside).cast("bigint")


def quantize(v: Column) -> Column:
    """Stored lane of a vector element: rounded, saturating at 16 bits."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), round_lane(v))).cast("bigint")


def mcc_risk(code: Column) -> Column:
    out = F.lit(OTHER_RISK)
    for mcc, risk in MCC_RISK.items():
        out = F.when(code == mcc, risk).otherwise(out)
    return out


def sq_dist_int(a: list[Column], b: list[Column]) -> Column:
    """Exact squared distance of integer lanes, unrolled so that it is compiled."""
    return reduce(add, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def sq_dist_f32(a: list[Column], b: list[Column]) -> Column:
    """Squared distance in single precision, summed in lane order."""
    value = lambda lane: (lane.cast("float") * f32(0.0001)).cast("float")
    steps = [(value(x) - value(y)).cast("float") for x, y in zip(a, b, strict=True)]
    return reduce(lambda s, d: (s + (d * d).cast("float")).cast("float"), steps[1:], (steps[0] * steps[0]).cast("float"))


def half_away(total: Column, n: Column) -> Column:
    """total / n of integers, rounded half away from zero, in integers."""
    return F.sign(total).cast("bigint") * F.call_function("div", 2 * F.abs(total) + n, 2 * n)


def lane_names(dims: int, prefix: str = "q") -> list[str]:
    return [f"{prefix}{i}" for i in range(dims)]


def explode_lanes(vector: Column, dims: int, prefix: str = "q") -> list[Column]:
    """Lane columns of an array of floats."""
    return [quantize(F.get(vector, i)).alias(f"{prefix}{i}") for i in range(dims)]
