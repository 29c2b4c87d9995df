"""Alert routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.constants import (DASHBOARD_URL, DRIFT_THRESHOLD, INCIDENT_CATEGORIES,
                               REVIEW_THRESHOLD, SEVERITY_DRIFT, SEVERITY_HIGH,
                               SEVERITY_REVIEW, SNIPPET_CHARS)


def severity(category, confidence, threshold: float = REVIEW_THRESHOLD):
    incident = category.isin(*INCIDENT_CATEGORIES)
    return (F.when(incident & (confidence >= F.lit(threshold)), F.lit(SEVERITY_HIGH))
            .when(incident & (confidence < F.lit(threshold)), F.lit(SEVERITY_REVIEW)))


def route(scored: DataFrame) -> DataFrame:
    """Incident records with their severity; noise and warning
    never alert on their own."""
    return (scored.withColumn("severity", severity(F.col("category"), F.col("confidence")))
            .where(F.col("severity").isNotNull()))


def payload(alerts: DataFrame, *carry: str) -> DataFrame:
    """Snippet, category and dashboard link per alert, and the columns in
    ``carry``."""
    return alerts.select(
        "log_id", "severity", "category",
        F.substring("message", 1, SNIPPET_CHARS).alias("snippet"),
        F.concat(F.lit(DASHBOARD_URL), F.col("log_id")).alias("dashboard_link"), *carry)


def drift_alerts(rolling: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Windows whose mean confidence is below the drift threshold."""
    return (rolling.where(F.col("avg_confidence") < F.lit(threshold))
            .withColumn("severity", F.lit(SEVERITY_DRIFT)))


def alert_summary(record_alerts: DataFrame, window_alerts: DataFrame) -> DataFrame:
    """Alert volume by severity."""
    return (record_alerts.select("severity").unionByName(window_alerts.select("severity"))
            .groupBy("severity").agg(F.count(F.lit(1)).alias("n")))
