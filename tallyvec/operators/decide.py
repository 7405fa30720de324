"""Decisions: fraud count to score, approval and response body; failures are approved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores as they are written in a response.
SCORE_TEXT = ["0.0", "0.2", "0.4", "0.6", "0.8", "1"]


def bounded(count: Column, n: int = 5) -> Column:
    """Counts below none are none, above all are all; null is none."""
    return F.least(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)), F.lit(n))


def score_columns(count: Column, n: int = 5, threshold: int = 3) -> dict[str, Column]:
    c = bounded(count, n)
    return {"fraud_score": c / F.lit(float(n)), "approved": c < threshold}


def response_body(count: Column, threshold: int = 3) -> Column:
    c = bounded(count)
    text = F.element_at(F.array(*map(F.lit, SCORE_TEXT)), (c + 1).cast("int"))
    return F.concat(F.lit('{"approved":'), (c < threshold).cast("string"), F.lit(',"fraud_score":'), text, F.lit("}"))


def decide(scored: DataFrame, threshold: int = 3) -> DataFrame:
    return scored.withColumns(score_columns(F.col("fraud_count"), 5, threshold)).withColumn("body", response_body(F.col("fraud_count"), threshold))


def route(method: str, url: str, ready: bool) -> tuple[int, dict[str, str], str]:
    """Status, headers and text that a request without a body gets; 0 asks for scoring."""
    path = url.split("?", 1)[0]
    allowed = {"/ready": "GET", "/fraud-score": "POST"}.get(path)
    if allowed is None:
        return 404, {}, ""
    if method != allowed:
        return 405, {"Allow": allowed}, ""
    if path == "/ready":
        return (200, {}, "ok") if ready else (503, {}, "not_ready")
    return 0, {}, ""
