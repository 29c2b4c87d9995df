"""Feedback table (S6, S7): append-only Parquet on shared storage.

The reference keeps feedback in a single-writer embedded database, which
pins the service to one replica.  Here every writer appends its own files;
rows are partitioned by ``batch`` (a caller token, or the micro-batch id of
a stream) and a batch is written with dynamic partition overwrite, so a
replayed batch replaces its own earlier attempt instead of duplicating it.

``id`` is a content hash of the batch token and the submitted fields rather
than a global counter (a sequence is not a scale-out primitive); duplicates
per ``log_id`` are kept, and resolved on read (``latest_feedback``) by
submission: ``timestamp``, then ``position`` in the batch.  Both are taken from
the requests where these carry them (a topic's timestamp and offset); else the
time is that of the batch's first write, which a replay keeps, and the position
is the order of the input rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.schemas import FEEDBACK, FEEDBACK_REQUEST

REQUIRED = [f.name for f in FEEDBACK_REQUEST.fields]
STORED = T.StructType(FEEDBACK.fields + [T.StructField("position", T.LongType()),
                                         T.StructField("batch", T.StringType())])


def ensure_feedback_table(spark: SparkSession, path: str) -> None:
    """Create the table (schema only) if it does not exist."""
    empty = spark.createDataFrame([], STORED)
    empty.write.mode("ignore").partitionBy("batch").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def prepare_feedback(requests: DataFrame, batch: str | int, submitted: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rejected rows with a reason).  All four fields are
    required strings; ``submitted`` stands in for a missing ``timestamp``."""
    now = F.current_timestamp() if submitted is None else F.lit(submitted)
    when = F.coalesce(F.col("timestamp").cast("timestamp"), now) if "timestamp" in requests.columns else now
    place = F.col("position").cast("long") if "position" in requests.columns else F.monotonically_increasing_id()
    reason = None
    for c in REQUIRED:
        cond = F.col(c).isNull()
        reason = (F.when(cond, F.lit(f"missing {c}")) if reason is None
                  else reason.when(cond, F.lit(f"missing {c}")))
    checked = requests.select(*REQUIRED, when.alias("timestamp"), place.alias("position")).withColumn("reason", reason)
    good = checked.where(F.col("reason").isNull()).drop("reason")
    token = str(batch)
    rows = good.select(
        F.xxhash64(F.lit(token), F.col("position"), *[F.col(c) for c in REQUIRED]).alias("id"),
        *REQUIRED, "timestamp", "position", F.lit(token).alias("batch"))
    return rows, checked.where(F.col("reason").isNotNull()).drop("timestamp", "position")


def first_written(spark: SparkSession, path: str, batch: str | int) -> datetime | None:
    """The time under which a batch is already stored, if it is."""
    ensure_feedback_table(spark, path)
    return read_feedback(spark, path).where(F.col("batch") == F.lit(str(batch))).agg(F.min("timestamp")).first()[0]


def save_feedback(requests: DataFrame, path: str, batch: str | int) -> DataFrame:
    """Append one batch of corrections; returns the rejected rows."""
    spark = requests.sparkSession
    rows, rejected = prepare_feedback(requests, batch, first_written(spark, path, batch))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(path))
    return rejected
