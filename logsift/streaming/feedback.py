"""Reviewer feedback as a stream (S6): JSON lines in, feedback table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsift.schemas import FEEDBACK_REQUEST
from logsift.sources.feedback_store import save_feedback
from logsift.streaming.classify import _write


def start_feedback(spark: SparkSession, source: str, out: str, checkpoint: str,
                   available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Files of one correction a line; the submitted time is the file's
    modification time, so a replayed micro-batch stores the same rows.
    Rejected rows go to ``<out>_rejected`` with their reason."""
    lines = spark.readStream.schema(FEEDBACK_REQUEST).json(source).select(
        "*", F.col("_metadata.file_modification_time").alias("timestamp"))

    def store(batch: DataFrame, batch_id: int) -> None:
        rejected = save_feedback(batch, out, batch_id)
        _write(rejected.withColumn("batch_id", F.lit(int(batch_id)).cast("long")), f"{out}_rejected")

    w = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
