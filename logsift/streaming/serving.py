"""What a classifier stream leaves besides its results: metrics, durations and
closed windows, as committed tables under the stream's output folder.

* ``rollup``: the micro-batch's rollup rows (A1, A2, A5, R3, R5 add up from
  them); a replay replaces its own.
* ``latency``: the measured duration of each request (A3).  A micro-batch is one
  request of the classifier; the responder has one row for each envelope, which
  waits as long as its batch takes.
* ``windows``: means of windows that the watermark has closed, written again by
  a batch whose late records change them (A6); ``late``: those records.  A
  reader takes each window's latest row, so late rows correct the mean instead
  of being lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.constants import LATENCY_BUCKETS, METRIC_LATENCY, METRIC_LOADED
from logsift.functions.histogram import histogram_rows
from logsift.operators import rollup
from logsift.sources.committed import CommittedTable

WINDOW_MINUTES = 5
DELAY_MINUTES = 10

LATENCY = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("latency_s", T.DoubleType()),
                        T.StructField("batch_id", T.LongType())])
PROGRESS = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("last_slot", T.LongType())])
WINDOWS = T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("avg_confidence", T.DoubleType()), T.StructField("batch_id", T.LongType())])
LATE = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("event_time", T.TimestampType()),
                     T.StructField("category", T.StringType()), T.StructField("confidence", T.DoubleType()),
                     T.StructField("batch_id", T.LongType())])
TABLES = {"rollup": rollup.ROLLUP, "latency": LATENCY, "progress": PROGRESS, "windows": WINDOWS, "late": LATE}


def table(spark: SparkSession, out: str, name: str) -> CommittedTable:
    return CommittedTable(spark, f"{out.rstrip('/')}/{name}", TABLES[name])


def day_of(slot):
    return F.timestamp_seconds(slot * rollup.SLOT_SECONDS).cast("date")


def record_batch(scored: DataFrame, out: str, batch_id: int) -> None:
    """Metrics, windows and late records of one scored micro-batch."""
    spark = scored.sparkSession
    mine = rollup.rollup(scored).persist()
    try:
        rows = table(spark, out, "rollup")
        rows.write(mine, batch_id, day_of(F.col("slot")))
        _close_windows(spark, scored, mine, rows, out, batch_id)
    finally:
        mine.unpersist()


def _close_windows(spark: SparkSession, scored: DataFrame, mine: DataFrame, rows: CommittedTable, out: str, batch_id: int) -> None:
    """Windows that this batch closes, and those closed before that its late
    records change, from the minutes of all batches."""
    progress = table(spark, out, "progress")
    bid = F.lit(int(batch_id)).cast("long").alias("batch_id")
    last = mine.agg(F.max("slot")).first()[0]
    before = progress.read().where(F.col("batch_id") < batch_id).agg(F.max("last_slot")).first()[0]
    seen = max((s for s in (last, before) if s is not None), default=None)
    # Slots up to which windows are closed: before this batch, and now.
    was = before - DELAY_MINUTES if before is not None else None
    now = seen - DELAY_MINUTES if seen is not None else None
    if now is not None:
        slot = F.col("slot")
        late = scored.where(rollup.slot_of(F.col("event_time")) < F.lit(was)) if was is not None else scored.limit(0)
        table(spark, out, "late").write(late.select("log_id", "event_time", "category", "confidence", bid), batch_id,
                                        F.col("event_time"))
        touched = mine.where(slot.isNotNull()).select(F.explode(F.array(*rollup.windows_of_slot(WINDOW_MINUTES))).alias("first")).distinct()
        low = touched.agg(F.min("first")).first()[0]
        low = min(x for x in (low, was - WINDOW_MINUTES if was is not None else None, now) if x is not None)
        near = rows.read().where((F.col("date") >= day_of(F.lit(low))) & (slot >= low) & (slot <= now + WINDOW_MINUTES))
        minutes = near.where("count > 0").groupBy("slot").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
        spread = minutes.select(F.explode(F.array(*rollup.windows_of_slot(WINDOW_MINUTES))).alias("first"), "sum", "count")
        closed = spread.groupBy("first").agg(F.sum("count").alias("n"), (F.sum("sum") / F.sum("count")).alias("avg_confidence"))
        end = F.col("first") + WINDOW_MINUTES
        fresh = end <= F.lit(now)
        if was is not None:
            newly = closed.where(fresh & (end > F.lit(was)))
            changed = closed.where(fresh & (end <= F.lit(was))).join(touched, "first", "left_semi")
            closed = newly.unionByName(changed)
        else:
            closed = closed.where(fresh)
        table(spark, out, "windows").write(closed.select("first", "n", "avg_confidence", bid), batch_id, day_of(F.col("first")))
    progress.write(spark.createDataFrame([(int(batch_id), last)], PROGRESS), batch_id, F.lit(None))


def record_latency(requests: DataFrame, seconds: float, out: str, batch_id: int) -> None:
    """One row for each ``request_id``."""
    rows = requests.select("request_id", F.lit(float(seconds)).alias("latency_s"), F.lit(int(batch_id)).cast("long").alias("batch_id"))
    table(requests.sparkSession, out, "latency").write(rows, batch_id, F.lit(None))


def closed_windows(spark: SparkSession, out: str) -> DataFrame:
    """``window_start, window_end, n, avg_confidence`` with all corrections."""
    best = F.max_by(F.struct("n", "avg_confidence"), F.col("batch_id")).alias("_l")
    latest = table(spark, out, "windows").read().groupBy("first").agg(best)
    start = F.timestamp_seconds(F.col("first") * rollup.SLOT_SECONDS)
    end = start + F.expr(f"INTERVAL {WINDOW_MINUTES} MINUTES")
    return latest.select(start.cast("timestamp_ntz").alias("window_start"), end.cast("timestamp_ntz").alias("window_end"), "_l.*")


def late_records(spark: SparkSession, out: str) -> DataFrame:
    return table(spark, out, "late").read().drop("date")


def merged_rollup(spark: SparkSession, out: str) -> DataFrame:
    return rollup.merge(table(spark, out, "rollup").read())


def latency_histogram(spark: SparkSession, out: str) -> DataFrame:
    return histogram_rows(table(spark, out, "latency").read(), "latency_s", LATENCY_BUCKETS, METRIC_LATENCY)


def snapshot(spark: SparkSession, out: str, loaded: DataFrame | None = None) -> DataFrame:
    """S11 of a stream: ``(metric, labels, le, value)``; ``loaded``: the
    ``(version, value)`` rows of the lifecycle log."""
    none = F.lit(None).cast("string")
    rows = rollup.metric_rows(table(spark, out, "rollup").read())
    rows = rows.unionByName(latency_histogram(spark, out).select("metric", F.lit("{}").alias("labels"), "le", "value"))
    if loaded is not None:
        rows = rows.unionByName(loaded.select(F.lit(METRIC_LOADED).alias("metric"),
                                              rollup.label_text(("version", F.col("version"))).alias("labels"),
                                              none.alias("le"), "value"))
    return rows
