"""One scan where one will do, and rollups that add up."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from logsift.operators import alerts, metrics, rollup
from logsift.operators.score import score
from logsift.plans import views
from logsift.plans.fixed_model import fixed_model, wide_model
from tests.conftest import SF_SMALL


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", ["metrics_snapshot", "alert_summary", "review_backlog", "correction_rate", "correction_pairs",
                                 "latest_feedback"])
def test_one_scan(spark, key):
    assert final_plan(E.queries()[key](spark, SF_SMALL)).count("FileScan") == 1


def test_wide_scores_without_exchange(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    plan = final_plan(score(docs, wide_model(docs), text="text"))
    assert "hashpartitioning" not in plan and "Join" not in plan


def test_no_shuffle_by_document(spark):
    for key in ("tfidf", "oov_transform"):
        plan = final_plan(E.queries()[key](spark, SF_SMALL))
        assert "Exchange" not in plan and "Window" not in plan and "regexp" not in plan


@pytest.fixture(scope="module")
def rows(spark):
    scored = score(views.logs(spark, SF_SMALL), fixed_model(spark)).select("log_id", "event_time", "category", "confidence")
    odd = spark.createDataFrame([("a", None, "error", 0.5), ("b", None, "noise", None)],
                                "log_id string, event_time timestamp, category string, confidence double")
    return scored.unionByName(odd).cache()


def values(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_rollup_gives_what_the_records_give(rows):
    r = rollup.rollup(rows)
    assert r.schema.simpleString() == rollup.ROLLUP.simpleString()
    assert values(rollup.rolling_mean(r)) == values(metrics.rolling_mean(rows))
    assert values(rollup.alert_summary(r)) == values(alerts.alert_summary(alerts.route(rows), alerts.drift_alerts(metrics.rolling_mean(rows))))
    parts = rows.withColumn("half", F.crc32("log_id") % 3)
    merged = rollup.merge(rollup.rollup(parts.where("half = 0")).unionByName(rollup.rollup(parts.where("half > 0"))))
    assert values(merged.select(r.columns)) == values(r)


def test_metric_rows_of_the_rollup(rows):
    got = rollup.metric_rows(rollup.rollup(rows))
    want = metrics.confidence_histogram(rows).select("metric", F.lit("{}").alias("labels"), "le", "value")
    assert values(got.where("labels = '{}'")) == values(want)
    counter = {(r.labels, r.value) for r in got.where("labels <> '{}'").collect()}
    assert counter == {(f'{{category="{r.category}",status_code="200"}}', r.value) for r in metrics.request_counter(rows).collect()}


def test_empty_rollup(rows):
    r = rollup.rollup(rows.limit(0))
    assert r.count() == 0 and rollup.rolling_mean(r).count() == 0 and rollup.alert_summary(r).count() == 0


def test_label_values_are_escaped(spark):
    df = spark.createDataFrame([('a"b\\c\nd',)], "v string")
    assert df.select(rollup.label_text(("x", F.col("v")))).first()[0] == '{x="a\\"b\\\\c\\nd"}'


def test_one_pass_snapshot_equals_its_parts(spark):
    served = views.served(spark, SF_SMALL).cache()
    life = served.where("version IS NOT NULL").select("version", "ts", "seq", F.col("state").alias("value"))
    parts = metrics.metrics_snapshot(metrics.request_counter(served), metrics.confidence_histogram(served),
                                     metrics.latency_histogram(served), metrics.model_loaded_gauge(life))
    assert values(metrics.served_metrics(served)) == values(parts)


def test_latest_state_by_time_then_sequence(spark):
    rows = [(None, None, None, "v1", t, s, x) for t, s, x in ((5, 1, 1), (5, 2, 0), (4, 9, 1))]
    rows += [("noise", 0.9, 0.1, "v2", 1, 1, 0), ("noise", 0.9, 0.1, "v2", 2, 0, 1), ("error", None, None, None, 9, 9, 0)]
    df = spark.createDataFrame(rows, "category string, confidence double, latency_s double, version string, ts long, seq long, state int")
    got = metrics.served_metrics(df.withColumn("ts", F.timestamp_seconds("ts"))).where("metric = 'model_loaded'").collect()
    assert {(r.labels, r.value) for r in got} == {('{version="v1"}', 0.0), ('{version="v2"}', 1.0)}
