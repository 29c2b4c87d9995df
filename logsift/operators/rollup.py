"""One pass over scored records: a small table that every metric reads.

``rollup`` counts records by minute, category and severity, with the sum of
their confidences and the cumulative bounds of the histogram, all in one
partial aggregate.  Its rows add up: those of two batches, or of a batch's
minutes, merge by ``merge``.  Counter (A1), histogram (A2), rolling mean (A5),
drift (R3) and alert volume (R5) are views of that table, so a batch job scans
the records once and a stream keeps the rows of each micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.constants import (CONFIDENCE_BUCKETS, DRIFT_THRESHOLD, METRIC_CONFIDENCE, METRIC_REQUESTS,
                               SEVERITY_DRIFT, STATUS_OK)
from logsift.functions.histogram import bound_columns, histogram_entries
from logsift.operators.alerts import severity

SLOT_SECONDS = 60
KEYS = ["slot", "category", "severity"]
BOUNDS = [f"le_{i}" for i in range(len(CONFIDENCE_BUCKETS))]
SUMS = ["n", *BOUNDS, "le_inf", "sum", "count"]
ROLLUP = T.StructType(
    [T.StructField("slot", T.LongType()), T.StructField("category", T.StringType()), T.StructField("severity", T.StringType())]
    + [T.StructField(c, T.DoubleType() if c == "sum" else T.LongType()) for c in SUMS])


def slot_of(ts: Column) -> Column:
    """Minutes since the epoch."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(SLOT_SECONDS * 1_000_000))


def rollup(scored: DataFrame, ts: str = "event_time") -> DataFrame:
    """``ROLLUP`` rows of scored records; a record without time counts in the
    slot null."""
    return scored.groupBy(slot_of(F.col(ts)).alias("slot"), "category",
                          severity(F.col("category"), F.col("confidence")).alias("severity")).agg(
        F.count(F.lit(1)).alias("n"), *bound_columns(F.col("confidence"), CONFIDENCE_BUCKETS))


def merge(rows: DataFrame, keys: Iterable[str] = tuple(KEYS)) -> DataFrame:
    """Rows of equal keys added up."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def windows_of_slot(window_minutes: int = 5) -> list[Column]:
    """First slots of the windows that a slot is part of."""
    return [F.col("slot") - F.lit(back) for back in range(window_minutes)]


def rolling_mean(rows: DataFrame, window_minutes: int = 5) -> DataFrame:
    """A5 over rollup rows: each minute feeds the windows that contain it."""
    minutes = rows.where(F.col("slot").isNotNull() & (F.col("count") > 0))
    spread = minutes.select(F.explode(F.array(*windows_of_slot(window_minutes))).alias("first"), "sum", "count")
    sums = spread.groupBy("first").agg(F.sum("sum").alias("s"), F.sum("count").alias("n"))
    start = F.timestamp_seconds(F.col("first") * F.lit(SLOT_SECONDS))
    return sums.select(start.cast("timestamp_ntz").alias("window_start"),
                       (start + F.expr(f"INTERVAL {window_minutes} MINUTES")).cast("timestamp_ntz").alias("window_end"),
                       "n", (F.col("s") / F.col("n")).alias("avg_confidence"))


def alert_summary(rows: DataFrame, window_minutes: int = 5, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """R5 in one plan: a rollup row is counted by its severity and feeds its
    windows, of which those with a low mean count as drift warnings."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    own = F.struct("severity", none.alias("first"), F.col("n").alias("n"), F.lit(0.0).alias("s"), zero.alias("c"))
    fed = [F.struct(F.lit(None).cast("string").alias("severity"), w.alias("first"), zero.alias("n"),
                    F.col("sum").alias("s"), F.col("count").alias("c")) for w in windows_of_slot(window_minutes)]
    entries = rows.select(F.inline(F.array(own, *fed))).where("severity IS NOT NULL OR first IS NOT NULL AND c > 0")
    sums = entries.groupBy("severity", "first").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    drift = F.col("severity").isNull()
    counted = sums.where(~drift | (F.try_divide("s", "c") < F.lit(threshold)))
    return (counted.groupBy(F.coalesce("severity", F.lit(SEVERITY_DRIFT)).alias("severity"))
            .agg(F.sum(F.when(drift, F.lit(1)).otherwise(F.col("n"))).alias("n")))


def counter_entry(labels: Column) -> Column:
    return F.struct(F.lit(METRIC_REQUESTS).alias("metric"), labels.alias("labels"), F.lit(None).cast("string").alias("le"),
                    F.col("n").cast("double").alias("value"))


def label_text(*pairs: tuple[str, Column]) -> Column:
    """Label set as exposition text ``{a="x",b="y"}``; backslashes, quotes and
    line ends in values are escaped."""
    parts = []
    for i, (name, value) in enumerate(pairs):
        for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            value = F.replace(value, F.lit(raw), F.lit(safe))
        parts += [F.lit(("," if i else "") + f'{name}="'), value, F.lit('"')]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def category_labels() -> Column:
    return label_text(("category", F.col("category")), ("status_code", F.lit(STATUS_OK)))


def metric_rows(rows: DataFrame) -> DataFrame:
    """A1 and A2 as ``(metric, labels, le, value)``."""
    entries = F.array(counter_entry(category_labels()),
                      *histogram_entries(METRIC_CONFIDENCE, CONFIDENCE_BUCKETS, labels=True))
    return rows.select(F.inline(entries)).groupBy("metric", "labels", "le").agg(F.sum("value").alias("value"))
