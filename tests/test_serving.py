"""Committed tables, streamed metrics, measured latency, corrected windows,
lifecycle log."""

import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logsift.operators import metrics, rollup
from logsift.operators.score import score
from logsift.plans import views
from logsift.plans.fixed_model import fixed_model
from logsift.sources.committed import CommittedTable
from logsift.sources.lifecycle import Serving, loaded_at, read_states
from logsift.streaming import serving
from logsift.streaming.classify import classify_batch, read_served, start_classifier, start_responder
from tests.conftest import SF_SMALL

SCHEMA = "x long, at timestamp"


def rows(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x long").select("x", F.timestamp_seconds(F.col("x") * 86_400).alias("at"))


def xs(df):
    return sorted(r.x for r in df.collect())


@pytest.fixture()
def table(spark, tmp):
    return CommittedTable(spark, f"{tmp}/t", SCHEMA)


def test_replay_replaces_and_readers_see_whole_batches(spark, table, monkeypatch):
    assert table.read().count() == 0
    table.write(rows(spark, 1, 2), 0, F.col("at"))
    before = table.read()
    table.write(rows(spark, 3), 1, F.col("at"))
    table.write(rows(spark, 1, 2, 9), 0, F.col("at"))
    assert xs(table.read()) == [1, 2, 3, 9] and xs(before) == [1, 2] and xs(table.read(before=1)) == [1, 2, 9]
    # A crash between the rows and the commit.
    monkeypatch.setattr(table, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.write(rows(spark, 50), 2, F.col("at"))
    monkeypatch.undo()
    assert xs(table.read()) == [1, 2, 3, 9]
    table.write(rows(spark, 50), 2, F.col("at"))
    table.write(rows(spark), 3, F.col("at"))
    assert xs(table.read()) == [1, 2, 3, 9, 50]


def test_compaction(spark, table):
    for b in range(5):
        table.write(rows(spark, b, b + 10).repartition(2), b, F.lit("2031-01-05").cast("date"))
    table.write(rows(spark, 77), 2, F.lit("2031-01-05").cast("date"))
    want = sorted([0, 10, 1, 11, 77, 3, 13, 4, 14])
    old = table.read()
    table.compact(upto=3)
    assert xs(table.read()) == want == xs(old)
    assert [(e.kind, e.batch) for e in table.valid()] == [("upto", 3), ("batch", 4)]
    assert not table.write(rows(spark, 0, 10), 0, F.lit(None)) and xs(table.read()) == want
    table.write(rows(spark, 5), 5, F.lit(None))
    table.compact()
    files = {r.f for r in table.read().select(F.input_file_name().alias("f")).collect()}
    assert len(files) == 2 and xs(table.read()) == sorted(want + [5])
    assert table.clean() == 8 and xs(table.read()) == sorted(want + [5]) and table.clean() == 0


def test_dates_are_pruned(spark, table):
    table.write(rows(spark, 1, 2, 3), 0, F.col("at"))
    df = table.read().where(F.col("date") == F.lit("1970-01-03").cast("date"))
    assert xs(df) == [2] and "PartitionFilters: [isnotnull(date" in df._jdf.queryExecution().executedPlan().toString()


def lines(spark, lo, hi, step=1):
    lv = views.logs(spark, SF_SMALL)
    return lv.where((F.col("rid") >= lo) & (F.col("rid") < hi)).select("log_id", "timestamp", "source", "level", "message")


def values(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def batch_windows(spark, out, upto=None):
    res = read_served(spark, out, "results")
    roll = metrics.rolling_mean(res)
    last = res.agg(F.max(rollup.slot_of(F.col("event_time")))).first()[0] - serving.DELAY_MINUTES
    closed = roll.where(F.unix_seconds(F.col("window_end").cast("timestamp")) <= last * 60)
    return closed.select("window_start", "window_end", "n", "avg_confidence")


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)])
def test_windows_and_snapshot_in_any_order_and_after_replays(spark, tmp, order):
    model, out, step = fixed_model(spark), f"{tmp}/out", 250
    for b, part in enumerate(order):
        classify_batch(lines(spark, part * step, (part + 1) * step), b, model, out)
    last = order[-1]
    classify_batch(lines(spark, last * step, (last + 1) * step), 3, model, out)
    res = read_served(spark, out, "results")
    assert res.count() == 4 * step
    assert values(serving.closed_windows(spark, out)) == values(batch_windows(spark, out))
    late = serving.late_records(spark, out)
    assert late.count() > 0 if order != (0, 1, 2, 3) else late.count() == 0
    assert values(serving.merged_rollup(spark, out)) == values(rollup.rollup(res))
    want = rollup.metric_rows(rollup.rollup(score(lines(spark, 0, 1000).withColumn(
        "event_time", F.try_to_timestamp("timestamp")), model)))
    got = serving.snapshot(spark, out)
    assert values(got.where("metric NOT LIKE '%latency%'")) == values(want)


def test_latency_of_requests(spark, tmp):
    import json
    line = {"timestamp": "day 7", "source": "gate-9", "level": "INFO", "message": "late round done, 8 trays counted"}
    os.makedirs(f"{tmp}/req")
    for name, n in (("a", 3), ("b", 2)):
        with open(f"{tmp}/req/{name}.json", "w") as f:
            f.write("\n".join(json.dumps({"logs": [line] * k}) for k in range(n)) + "\n")
    start_responder(spark, f"{tmp}/req", fixed_model(spark), f"{tmp}/out", f"{tmp}/ckpt", max_files=1).awaitTermination(300)
    taken = serving.table(spark, f"{tmp}/out", "latency").read().collect()
    ids = {r.request_id for r in read_served(spark, f"{tmp}/out", "responses").collect()}
    assert {r.request_id for r in taken} == ids and len(taken) == 5 and all(r.latency_s > 0 for r in taken)
    hist = {(r.metric.rsplit("_", 1)[1], r.le): r.value for r in serving.latency_histogram(spark, f"{tmp}/out").collect()}
    assert hist["count", None] == hist["bucket", "+Inf"] == 5
    assert abs(hist["sum", None] - sum(r.latency_s for r in taken)) < 1e-9
    assert hist["bucket", "1.0"] == sum(r.latency_s <= 1 for r in taken)


def wait_for(check, seconds=30):
    end = time.time() + seconds
    while not check() and time.time() < end:
        time.sleep(0.2)
    assert check()


def test_lifecycle_of_two_versions_and_a_crash(spark, tmp):
    path = f"{tmp}/states"
    lines(spark, 0, 50).drop("log_id").coalesce(1).write.parquet(f"{tmp}/in")
    one, two = fixed_model(spark), fixed_model(spark)
    one.version, two.version = "v1", "v2"

    def loaded(when=None):
        return {r.version: r.value for r in loaded_at(read_states(spark, path), when).collect()}

    crashed = Serving(spark, path, "v1", "host-1", lease=timedelta(seconds=60))
    up = datetime.now(timezone.utc)
    assert loaded() == {"v1": 1.0}
    # The process dies: nobody writes, the lease runs out.
    assert loaded(up + timedelta(seconds=90)) == {"v1": 0.0}
    q = start_classifier(spark, f"{tmp}/in", two, f"{tmp}/out", f"{tmp}/ckpt", lifecycle=path, server="host-1")
    q.awaitTermination(300)
    wait_for(lambda: loaded().get("v2") == 0.0)
    assert loaded() == {"v1": 0.0, "v2": 0.0}
    states = read_states(spark, path).orderBy("seq").collect()
    assert [(r.version, r.state, r.reason) for r in states][:3] == [("v1", 1, "loaded"), ("v1", 0, "lost"), ("v2", 1, "loaded")]
    assert states[1].run == crashed.run and states[-1].reason == "stopped"
    during = max(r.ts for r in states if r.version == "v2" and r.state == 1)
    assert loaded(during.replace(tzinfo=timezone.utc) if during.tzinfo is None else during)["v1"] == 0.0
    snap = serving.snapshot(spark, f"{tmp}/out", loaded_at(read_states(spark, path)))
    assert {(r.labels, r.value) for r in snap.where("metric = 'model_loaded'").collect()} == {
        ('{version="v1"}', 0.0), ('{version="v2"}', 0.0)}


def test_failed_query_unloads(spark, tmp):
    path = f"{tmp}/states"
    os.makedirs(f"{tmp}/in")
    lines(spark, 0, 5).drop("log_id").coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    model = fixed_model(spark)
    model.intercepts = None
    q = start_classifier(spark, f"{tmp}/in", model, f"{tmp}/out", f"{tmp}/ckpt", lifecycle=path)
    with pytest.raises(Exception):
        q.awaitTermination(300)
    wait_for(lambda: "failed" in {r.reason for r in read_states(spark, path).collect()})
    assert loaded_at(read_states(spark, path)).first().value == 0.0
