"""The log of model states (A4): who loaded which version, and until when that
can be believed.

A serving run appends rows: ``state`` 1 when it has loaded a model, 1 again
with every micro-batch (which extends its lease), 0 when it ends, whether it
was stopped or failed.  A process that dies writes nothing: its lease runs out,
and the next run on the same server writes the missing row 0.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

LEASE = timedelta(minutes=10)
STATES = T.StructType([T.StructField("version", T.StringType()), T.StructField("ts", T.TimestampType()),
                       T.StructField("seq", T.LongType()), T.StructField("state", T.IntegerType()),
                       T.StructField("until", T.TimestampType()), T.StructField("server", T.StringType()),
                       T.StructField("run", T.StringType()), T.StructField("reason", T.StringType())])


def _now() -> datetime:
    return datetime.now(timezone.utc)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], STATES).write.mode("ignore").parquet(path)
    return spark.read.schema(STATES).parquet(path)


def _append(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, STATES).coalesce(1).write.mode("append").parquet(path)


def _latest(states: DataFrame, *keys: str) -> DataFrame:
    columns = [c for c in states.columns if c not in keys]
    best = F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("_l")
    return states.groupBy(*keys).agg(best).select(*keys, "_l.*")


class Serving:
    """One serving run of a model version on a server."""

    def __init__(self, spark: SparkSession, path: str, version: str, server: str, lease: timedelta = LEASE):
        self.spark, self.path, self.version, self.server, self.lease = spark, path, version, server, lease
        self.run = uuid.uuid4().hex
        lost = _latest(read_states(spark, path).where(F.col("server") == server), "run").where("state = 1").collect()
        if lost:
            now = _now()
            _append(spark, path, [(r.version, now, time.time_ns(), 0, now, server, r.run, "lost") for r in lost])
        self._write(1, "loaded")

    def _write(self, state: int, reason: str) -> None:
        now = _now()
        _append(self.spark, self.path, [(self.version, now, time.time_ns(), state, now + self.lease if state else now,
                                         self.server, self.run, reason)])

    def beat(self) -> None:
        """Extend the lease; called with every micro-batch."""
        self._write(1, "batch")

    def end(self, reason: str = "stopped") -> None:
        self._write(0, reason)

    def end_with(self, query) -> None:
        """Write the row 0 when the streaming query ends."""
        serving, query_id = self, str(query.runId)

        class Ending(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                pass

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                if str(event.runId) == query_id:
                    serving.end("failed" if event.exception else "stopped")

        self.listener = Ending()
        self.spark.streams.addListener(self.listener)
        if not query.isActive:
            # It ended before the listener was there; a second row 0 is harmless.
            self.end("failed" if query.exception() else "stopped")


def loaded_at(states: DataFrame, when: datetime | None = None) -> DataFrame:
    """``(version, value)`` as of ``when`` (now): 1 where a run of the version
    has it loaded and its lease has not run out."""
    when = F.lit(when or _now())
    runs = _latest(states.where(F.col("ts") <= when), "version", "run")
    up = (F.col("state") == 1) & (F.col("until") >= when)
    return runs.groupBy("version").agg(F.max(up.cast("double")).alias("value"))
