"""Streaming classification and drift mean: results equal batch scoring,
replays do not duplicate, the windowed mean equals the batch form."""

import os

from pyspark.sql import functions as F

from logsift.operators.metrics import rolling_mean
from logsift.operators.score import score
from logsift.plans import views
from logsift.plans.fixed_model import fixed_model
from logsift.streaming.classify import (classify_batch, read_served, start_classifier,
                                        start_rolling_mean, with_event_time)
from tests.conftest import SF_SMALL


def _write_input(spark, path, parts=4):
    lv = views.logs(spark, SF_SMALL).select("rid", "timestamp", "source", "level", "message")
    bounds = lv.agg(F.min("rid"), F.max("rid")).collect()[0]
    step = (bounds[1] - bounds[0]) // parts + 1
    for i in range(parts):                   # files in event-time order
        lo = bounds[0] + i * step
        (lv.where((F.col("rid") >= lo) & (F.col("rid") < lo + step)).drop("rid")
         .coalesce(1).write.parquet(f"{path}/part{i:03d}"))
    return lv


def test_stream_matches_batch_and_rolling(spark, tmp):
    src = f"{tmp}/in"
    os.makedirs(src)
    lv = _write_input(spark, f"{tmp}/stage")
    for d in sorted(os.listdir(f"{tmp}/stage")):
        for f in os.listdir(f"{tmp}/stage/{d}"):
            if f.endswith(".parquet"):
                os.link(f"{tmp}/stage/{d}/{f}", f"{src}/{d}-{f}")
    model = fixed_model(spark)
    q = start_classifier(spark, src, model, f"{tmp}/out", f"{tmp}/ckpt", max_files=1)
    q.awaitTermination(300)
    res = read_served(spark, f"{tmp}/out", "results")
    assert res.count() == lv.count()
    assert res.select("batch_id").distinct().count() == 4
    batch = score(lv.withColumn("log_id", F.col("rid")), model).select("message", "category",
                                                                       "confidence")
    a = sorted((r.message, r.category, round(r.confidence, 9)) for r in batch.collect())
    b = sorted((r.message, r.category, round(r.confidence, 9))
               for r in res.select("message", "category", "confidence").collect())
    assert a == b

    # Watermarked stream over the results vs the batch rolling mean.
    r = start_rolling_mean(spark, f"{tmp}/out/results/data", f"{tmp}/drift", f"{tmp}/ckpt2")
    r.awaitTermination(300)
    streamed = spark.read.parquet(f"{tmp}/drift")
    batch_roll = rolling_mean(with_event_time(res))
    closed = batch_roll.where(F.col("window_end") <= streamed.agg(F.max("window_end")).collect()[0][0])
    s = {(x.window_start.isoformat(), x.n, round(x.avg_confidence, 9)) for x in streamed.collect()}
    bset = {(x.window_start.isoformat(), x.n, round(x.avg_confidence, 9)) for x in closed.collect()}
    assert s == bset and len(s) > 0

    # R3 on the stream: the drift alerts are the closed windows below 0.70.
    da = start_rolling_mean(spark, f"{tmp}/out/results/data", f"{tmp}/drift_alerts", f"{tmp}/ckpt3",
                            alerts_only=True)
    da.awaitTermination(300)
    got = {x.window_start.isoformat() for x in spark.read.parquet(f"{tmp}/drift_alerts").collect()}
    want = {x.window_start.isoformat() for x in closed.where("avg_confidence < 0.70").collect()}
    assert got == want and len(got) > 0

    # Replay of batch 0: same ids, no duplicates.
    first = spark.read.parquet(f"{src}").limit(0)
    before = res.count()
    files = sorted(os.listdir(src))[:1]
    replay = spark.read.parquet(*[f"{src}/{f}" for f in files]).select(
        "_metadata.file_path", "_metadata.row_index", "*")
    replay = replay.select(F.sha2(F.concat_ws(":", "file_path", F.col("row_index").cast("string")),
                                  256).alias("log_id"), "timestamp", "source", "level", "message")
    classify_batch(replay, 0, model, f"{tmp}/out")
    after = read_served(spark, f"{tmp}/out", "results")
    assert after.count() == before and first.count() == 0
    assert after.select("log_id").distinct().count() == before


def test_request_envelopes_in_responses_out(spark, tmp):
    """One envelope per line; one response per request, in request order."""
    import json
    from logsift.streaming.classify import start_responder
    src = f"{tmp}/req"
    os.makedirs(src)
    reqs = [
        {"logs": [{"timestamp": "2031-01-05T23:59:01Z", "source": "pump-4", "level": "DEBUG",
                   "message": "early round done, 40 trays counted"}]},
        {"logs": [{"timestamp": "day 5", "source": "gate-2", "level": "DEBUG", "message": "late round done, 12 trays counted"},
                  {"timestamp": "day 5", "source": "gate-2", "level": "WARN",
                   "message": "guard called, cloned badge at yard gate"},
                  {"timestamp": "day 6", "source": "gate-3", "level": "WARN", "message": "bed-7 drifting, rising heat"}]},
        {"logs": []},
    ]
    with open(f"{src}/batch-0.json", "w") as f:
        for r in reqs:
            f.write(json.dumps(r) + "\n")
    model = fixed_model(spark)
    q = start_responder(spark, src, model, f"{tmp}/resp", f"{tmp}/ckpt-r")
    q.awaitTermination(300)
    got = read_served(spark, f"{tmp}/resp", "responses").collect()
    sizes = sorted(len(r.results) for r in got)
    assert sizes == [0, 1, 3]              # the empty request gets an empty list
    three = [r for r in got if len(r.results) == 3][0].results
    assert [x.category for x in three] == ["noise", "security", "warning"]
    assert all(x.log_id for x in three) and len({x.log_id for x in three}) == 3


def test_equal_malformed_null_and_empty_requests(spark, tmp):
    """As many responses as request lines; what is rejected is kept apart."""
    import json
    from logsift.streaming.classify import start_responder
    line = {"timestamp": "day 7", "source": "gate-9", "level": "INFO", "message": "late round done, 8 trays counted"}
    good = json.dumps({"logs": [line]})
    part = json.dumps({"logs": [line, {**line, "message": None}]})
    lines = [good, good, good, part, '{"logs": []}', "not json", "{}", '{"logs": 3}']
    os.makedirs(f"{tmp}/req")
    with open(f"{tmp}/req/a.json", "w") as f:
        f.write("\n".join(lines) + "\n")
    start_responder(spark, f"{tmp}/req", fixed_model(spark), f"{tmp}/out", f"{tmp}/ckpt-e").awaitTermination(300)
    got = read_served(spark, f"{tmp}/out", "responses").collect()
    assert len(got) == len(lines) == len({r.request_id for r in got})
    assert sorted((len(r.results), r.error) for r in got if r.error is None) == [(0, None)] + 3 * [(1, None)]
    assert [len(r.results) for r in got if r.error == "rejected lines: 1"] == [1]
    assert [len(r.results) for r in got if r.error == "malformed request"] == [0, 0, 0]
    bad = read_served(spark, f"{tmp}/out", "request_quarantine").collect()
    assert sorted(r.reason for r in bad) == 3 * ["malformed request"] + ["missing message"]
    ids = [x.log_id for r in got for x in r.results]
    assert len(ids) == len(set(ids)) == 4


def test_record_read_twice_counts_once(spark, tmp):
    """A replay rewrites its files under new names; the mean stays."""
    from logsift.streaming.classify import RESULT_SCHEMA
    rows = spark.range(50).select(
        F.col("id").cast("string").alias("log_id"), F.timestamp_seconds(F.col("id") * 10 + 1_000_000).alias("event_time"),
        (F.col("id") / 100).alias("confidence"))
    rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in RESULT_SCHEMA.fields]).coalesce(1)
    for _ in range(2):
        rows.write.mode("append").parquet(f"{tmp}/results")
    end = rows.limit(1).withColumn("log_id", F.lit("end")).withColumn("event_time", F.timestamp_seconds(F.lit(1_090_000)))
    end.write.mode("append").parquet(f"{tmp}/results")
    start_rolling_mean(spark, f"{tmp}/results", f"{tmp}/mean", f"{tmp}/ckpt-m").awaitTermination(300)
    got = spark.read.parquet(f"{tmp}/mean").agg(F.sum("n")).first()[0]
    assert got == 50 * 5


def test_feedback_stream(spark, tmp):
    import json
    from logsift.sources.feedback_store import read_feedback
    from logsift.streaming.feedback import start_feedback
    os.makedirs(f"{tmp}/in")
    row = {"log_id": "r1", "message": "m", "predicted_category": "noise", "true_category": "error"}
    with open(f"{tmp}/in/a.json", "w") as f:
        f.write(json.dumps(row) + "\n" + json.dumps({**row, "true_category": None}) + "\n")
    start_feedback(spark, f"{tmp}/in", f"{tmp}/fb", f"{tmp}/ckpt-f").awaitTermination(300)
    stored = read_feedback(spark, f"{tmp}/fb").collect()
    assert [(r.log_id, r.true_category) for r in stored] == [("r1", "error")] and stored[0].timestamp is not None
    assert [r.reason for r in spark.read.parquet(f"{tmp}/fb_rejected").collect()] == ["missing true_category"]


def test_kafka_source_without_connector_says_so(spark):
    from logsift.streaming.classify import kafka_log_stream
    try:
        df = kafka_log_stream(spark, {"kafka.bootstrap.servers": "unused:9092",
                                      "subscribe": "logs"})
    except RuntimeError as e:
        assert "connector" in str(e)
    else:                                   # connector present: schema is right
        assert df.columns == ["log_id", "timestamp", "source", "level", "message"]
