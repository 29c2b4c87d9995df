"""Request and response envelopes.

A request carries ``{"logs": [LogLine, ...]}``; a response carries the
results in the request's order.  Envelopes are bounded by the request size,
so collecting one request's records into an array is bounded too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.schemas import CLASSIFY_REQUEST


def build_requests(logs: DataFrame, request_id: str = "request_id", pos: str = "pos") -> DataFrame:
    """(request_id, payload): records of one request as a JSON envelope,
    in ``pos`` order."""
    line = F.struct("timestamp", "source", "level", "message")
    grouped = logs.groupBy(request_id).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), line.alias("line"))))
        .alias("_items"))
    return grouped.select(
        request_id,
        F.to_json(F.struct(F.transform("_items", lambda x: x["line"]).alias("logs")))
        .alias("payload"))


def explode_requests(requests: DataFrame, request_id: str = "request_id",
                     payload: str = "payload") -> DataFrame:
    """Parse envelopes and emit one row per log line with its position.
    A payload that does not parse gives no rows (``from_json`` -> null)."""
    parsed = requests.select(request_id, F.from_json(payload, CLASSIFY_REQUEST).alias("_r"))
    return parsed.select(request_id, F.posexplode("_r.logs").alias("pos", "_l")).select(
        request_id, "pos", "_l.timestamp", "_l.source", "_l.level", "_l.message")


def with_request_error(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """``error``: set for a payload without a list of log lines."""
    logs = F.from_json(payload, CLASSIFY_REQUEST)["logs"]
    return requests.withColumn("error", F.when(logs.isNull(), F.lit("malformed request")))


def collect_results(scored: DataFrame, request_id: str = "request_id", pos: str = "pos") -> DataFrame:
    """(request_id, results) with results ordered by position."""
    item = F.struct(F.col(pos).alias("pos"), "log_id", "category", "confidence", "needs_review")
    grouped = scored.groupBy(request_id).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return grouped.select(request_id, F.transform("_items", lambda x: F.struct(
        x["log_id"].alias("log_id"), x["category"].alias("category"),
        x["confidence"].alias("confidence"), x["needs_review"].alias("needs_review")))
        .alias("results"))
