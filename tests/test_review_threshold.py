"""Review flag and alert routing at the threshold (strict ``<``)."""

from pyspark.sql import functions as F

from logsift.constants import (REVIEW_THRESHOLD, SEVERITY_HIGH, SEVERITY_REVIEW)
from logsift.operators import alerts
from logsift.operators.score import needs_review


CATEGORIES = ["error", "noise", "security", "warning"]
STEPS = {"below": -1e-9, "at": 0.0, "over": 1e-9}


def test_boundaries(spark):
    """Every category just below, at and just over the threshold."""
    rows = [(f"{c}-{s}", c, REVIEW_THRESHOLD + d) for c in CATEGORIES for s, d in STEPS.items()]
    df = spark.createDataFrame(rows, "log_id string, category string, confidence double")
    flagged = {r.log_id for r in df.where(needs_review(F.col("confidence"))).collect()}
    assert flagged == {f"{c}-below" for c in CATEGORIES}


def test_alert_routing_boundaries(spark):
    rows = [("a", "error", 0.75, "m"), ("b", "error", 0.7499, "m"), ("c", "security", 0.9, "m"),
            ("d", "warning", 0.1, "m"), ("e", "noise", 0.2, "m")]
    df = spark.createDataFrame(rows, "log_id string, category string, confidence double, message string")
    got = {r.log_id: r.severity for r in alerts.route(df).collect()}
    assert got == {"a": SEVERITY_HIGH, "b": SEVERITY_REVIEW, "c": SEVERITY_HIGH}
