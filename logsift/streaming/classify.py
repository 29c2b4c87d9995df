"""Streaming classification (S3) and the streaming drift mean.

``start_classifier``: file stream of log lines (label already masked) ->
per micro-batch: validation (P4), scoring (I1-I6), review flag (P5), alert
routing (R1/R2) -> three Parquet tables (results, alerts, quarantine).

* The scorer aggregates per record, which would be streaming state; it runs
  inside ``foreachBatch`` on the micro-batch instead, where it is a plain
  batch plan.
* Each micro-batch goes into committed tables (``sources/committed.py``): a
  replayed batch replaces its own rows, a batch that failed half-way is not
  seen, and readers prune by date.  The reference drops a failed batch instead.
* The batch's metrics, measured duration, closed windows and late records go
  into tables of their own (``streaming/serving.py``).
* Record ids come from the record's place in the input (file, row), so a
  replay produces the same ``log_id`` and feedback joins back.

``start_rolling_mean``: a second query over the results table: watermark
on the event time, sliding 5-minute windows, append mode; windows close
when the watermark passes them.  Records are counted once by ``log_id``.  Late rows beyond the watermark are dropped
by Spark and counted in the query progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logsift.constants import DRIFT_SLIDE, DRIFT_WINDOW
from logsift.operators import alerts
from logsift.operators.pipeline_score import score_pipeline
from logsift.operators.score import TextModel, score
from logsift.operators.validate import split_valid
from logsift.schemas import LOG_LINE
from logsift.sources.envelope import collect_results, explode_requests, with_request_error
from logsift.session import checkpoint_dir
from logsift.sources.committed import CommittedTable
from logsift.sources.lifecycle import Serving
from logsift.sources.model_store import version_or_unknown
from logsift.streaming import serving

RESULT_COLUMNS = ["log_id", "timestamp", "event_time", "source", "level", "message",
                  "category", "confidence", "needs_review", "model_version"]


def _reader(spark: SparkSession, max_files: int | None):
    """A stream reader; without ``max_files`` a trigger takes every new file."""
    reader = spark.readStream
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def log_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files of log lines, read as a stream with an explicit schema;
    ``log_id`` from (file, row)."""
    raw = _reader(spark, max_files).schema(LOG_LINE).parquet(path)
    rid = F.concat_ws(":", F.col("_metadata.file_path"),
                      F.col("_metadata.row_index").cast("string"))
    return raw.select(F.sha2(rid, 256).alias("log_id"), *[f.name for f in LOG_LINE.fields])


def kafka_log_stream(spark: SparkSession, options: dict) -> DataFrame:
    """Log lines as JSON values on a Kafka topic (``options`` are the Kafka
    source options, e.g. ``kafka.bootstrap.servers`` and ``subscribe``).
    ``log_id`` comes from (topic, partition, offset): stable under replay.
    Needs the Spark Kafka connector on the classpath."""
    try:
        raw = spark.readStream.format("kafka").options(**options).load()
    except Exception as e:
        raise RuntimeError("the Kafka source needs the spark-sql-kafka connector "
                           "on the classpath") from e
    rid = F.concat_ws(":", "topic", F.col("partition").cast("string"),
                      F.col("offset").cast("string"))
    line = F.from_json(F.col("value").cast("string"), LOG_LINE)
    return raw.select(F.sha2(rid, 256).alias("log_id"), line.alias("_l")).select(
        "log_id", *[F.col(f"_l.{f.name}").alias(f.name) for f in LOG_LINE.fields])


def with_event_time(df: DataFrame) -> DataFrame:
    """Parse the ISO text; an unparseable time gives null (the record is
    still classified, only time windows leave it out)."""
    return df.withColumn("event_time", F.try_to_timestamp(F.col("timestamp")))


def _write(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def served_table(spark: SparkSession, out: str, name: str) -> CommittedTable:
    return CommittedTable(spark, f"{out.rstrip('/')}/{name}", SERVED[name])


def read_served(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The committed rows of a table that a stream writes to ``out``."""
    return served_table(spark, out, name).read()


def _commit(df: DataFrame, out: str, name: str, batch_id: int, date: Column) -> None:
    bid = F.lit(int(batch_id)).cast("long").alias("batch_id")
    served_table(df.sparkSession, out, name).write(df.select("*", bid), batch_id, date)


def classify_batch(batch: DataFrame, batch_id: int, model: TextModel, out: str) -> None:
    """One micro-batch: results, alerts and quarantined records; and what the
    batch adds to the metrics."""
    started = time.perf_counter()
    batch = with_event_time(batch)
    valid, bad = split_valid(batch)
    pipeline = model.extra.get("pipeline")
    if pipeline is not None:      # row-local: no shuffle in the micro-batch
        scored = score_pipeline(valid, pipeline, model.classes, model.version).persist()
    else:
        scored = score(valid, model).persist()
    try:
        day = F.col("event_time")
        _commit(scored.select(*RESULT_COLUMNS), out, "results", batch_id, day)
        _commit(alerts.payload(alerts.route(scored), "event_time"), out, "alerts", batch_id, day)
        _commit(bad.select("log_id", "timestamp", "source", "level", "message", "reason"), out, "quarantine", batch_id,
                F.try_to_timestamp(F.col("timestamp")))
        request = batch.sparkSession.createDataFrame([(f"batch-{batch_id}",)], "request_id string")
        serving.record_latency(request, time.perf_counter() - started, out, batch_id)
        serving.record_batch(scored, out, batch_id)
    finally:
        scored.unpersist()


def _checkpoint(spark: SparkSession, given: str | None, name: str) -> str:
    """The caller's location, else a folder under the shared
    ``spark.checkpoint.dir`` of the session."""
    return given or f"{checkpoint_dir(spark).rstrip('/')}/logsift/{name}"


def start_classifier(spark: SparkSession, source: str, model: TextModel, out: str,
                     checkpoint: str | None = None, available_now: bool = True,
                     interval: str = "2 seconds", max_files: int | None = None,
                     lifecycle: str | None = None, server: str = "classifier") -> StreamingQuery:
    """S3.  The model is loaded before the query starts (S9) and captured by
    the batch function; it is never refitted while serving.  With
    ``lifecycle`` the run's states are logged there (A4)."""
    checkpoint = _checkpoint(spark, checkpoint, "classify")
    states = Serving(spark, lifecycle, version_or_unknown(model.version), server) if lifecycle else None

    def each(df: DataFrame, bid: int) -> None:
        classify_batch(df, bid, model, out)
        if states:
            states.beat()

    w = log_stream(spark, source, max_files).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    query = w.start()
    if states:
        states.end_with(query)
    return query


RESULT_SCHEMA = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("needs_review", T.BooleanType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])
SERVED = {
    "results": RESULT_SCHEMA,
    "alerts": ("log_id string, severity string, category string, snippet string, dashboard_link string, "
               "event_time timestamp, batch_id long"),
    "quarantine": ("log_id string, timestamp string, source string, level string, message string, "
                   "reason string, batch_id long"),
    "responses": ("request_id string, results array<struct<log_id: string, category: string, "
                  "confidence: double, needs_review: boolean>>, error string, batch_id long"),
    "request_quarantine": "request_id string, pos int, payload string, reason string, batch_id long",
}


def rolling_mean_stream(results: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Sliding-window mean confidence over a stream of results.  A
    replayed batch rewrites its files, which the file source takes as new
    rows; a record counts once, by its ``log_id``, within the watermark."""
    return (results.where(F.col("event_time").isNotNull())
            .withWatermark("event_time", watermark)
            .dropDuplicatesWithinWatermark(["log_id"])
            .groupBy(F.window("event_time", DRIFT_WINDOW, DRIFT_SLIDE))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"))
            .select(F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), "n", "avg_confidence"))


def drift_alert_stream(results: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """R3 on a stream: closed windows whose mean confidence is below the
    drift threshold (append mode emits a window once, when it closes)."""
    return alerts.drift_alerts(rolling_mean_stream(results, watermark))


def start_rolling_mean(spark: SparkSession, results_path: str, out: str,
                       checkpoint: str | None = None,
                       watermark: str = "10 minutes", available_now: bool = True,
                       max_files: int | None = None,
                       alerts_only: bool = False) -> StreamingQuery:
    """A6 over the results table.  By default a trigger takes every new file:
    one classification batch is written as several files that each span the
    batch's whole time range, so reading them one by one would make rows
    late.  Feed backfills in event-time order (or use the batch form)."""
    checkpoint = _checkpoint(spark, checkpoint, "drift_alerts" if alerts_only else "rolling_mean")
    stream = _reader(spark, max_files).schema(RESULT_SCHEMA).parquet(results_path)
    q = drift_alert_stream(stream, watermark) if alerts_only else rolling_mean_stream(stream, watermark)
    w = (q.writeStream.outputMode("append")
         .format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Text files with one JSON request envelope per line: (request_id,
    payload); ``request_id`` from file and envelope content, so a replay gives
    the same ids.  Equal requests of a file share it until ``number_requests``
    tells them apart."""
    raw = _reader(spark, max_files).text(path)
    return raw.select(F.sha2(F.concat_ws("\n", F.col("_metadata.file_path"), F.col("value")), 256)
                      .alias("request_id"), F.col("value").alias("payload"))


def number_requests(batch: DataFrame) -> DataFrame:
    """One row and one ``request_id`` per request.  A file is read whole by
    one micro-batch, so equal requests meet here; as their rows are equal, any
    order of their numbers is the same result."""
    times = batch.groupBy("request_id", "payload").agg(F.count(F.lit(1)).alias("n"))
    one = times.select("request_id", "payload", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    return one.select(F.sha2(F.concat_ws(":", "request_id", F.col("k").cast("string")), 256).alias("request_id"),
                      "payload")


def respond_batch(batch: DataFrame, batch_id: int, model: TextModel, out: str) -> None:
    """One micro-batch of requests: parse (S4), validate (P4), score, and
    write one response envelope per request with its results in request order
    (S5).  An empty request gets an empty result list.  A request that does
    not parse, or has rejected lines, says so in ``error``; what was rejected
    is in the quarantine table with its reason."""
    started = time.perf_counter()
    requests = with_request_error(number_requests(batch)).persist()
    try:
        lines = explode_requests(requests)
        lines = with_event_time(lines.withColumn(
            "log_id", F.sha2(F.concat_ws(":", "request_id", F.col("pos").cast("string")), 256)))
        valid, bad = split_valid(lines)
        pipeline = model.extra.get("pipeline")
        if pipeline is not None:
            scored = score_pipeline(valid, pipeline, model.classes, model.version)
        else:
            scored = score(valid, model)
        results = collect_results(scored)
        rejected = bad.groupBy("request_id").agg(F.count(F.lit(1)).alias("_bad"))
        empty = F.array().cast(results.schema["results"].dataType)
        responses = (requests.select("request_id", "error")
                     .join(results, "request_id", "left").join(rejected, "request_id", "left")
                     .select("request_id", F.coalesce("results", empty).alias("results"),
                             F.coalesce("error", F.concat(F.lit("rejected lines: "), F.col("_bad").cast("string")))
                             .alias("error")))
        undated = F.lit(None)
        _commit(responses, out, "responses", batch_id, undated)
        serving.record_latency(requests, time.perf_counter() - started, out, batch_id)
        whole = requests.where(F.col("error").isNotNull()).select(
            "request_id", F.lit(None).cast("int").alias("pos"), "payload", F.col("error").alias("reason"))
        part = bad.select("request_id", "pos", F.to_json(F.struct("timestamp", "source", "level", "message"))
                          .alias("payload"), "reason")
        _commit(whole.unionByName(part), out, "request_quarantine", batch_id, undated)
    finally:
        requests.unpersist()


def start_responder(spark: SparkSession, source: str, model: TextModel, out: str,
                    checkpoint: str | None = None, available_now: bool = True,
                    interval: str = "2 seconds", max_files: int | None = None) -> StreamingQuery:
    """Request envelopes in, response envelopes out, per micro-batch."""
    checkpoint = _checkpoint(spark, checkpoint, "respond")
    w = (request_stream(spark, source, max_files).writeStream
         .foreachBatch(lambda df, bid: respond_batch(df, bid, model, out))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
