"""CSV round trip, envelopes, feedback table and model store."""

import pytest
from pyspark.sql import functions as F

from logsift.operators.feedback import latest_feedback
from logsift.plans.fixed_model import fixed_model
from logsift.operators.score import TextModel, score
from logsift.schemas import LABELLED_LOG
from logsift.sources import envelope, feedback_store, logcsv, model_store


def test_csv_round_trip_keeps_text(spark, tmp):
    rows = [("t1", "s", "INFO", 'quote " inside, comma', "noise"),
            ("t2", "s", "ERROR", "line one\nline two", "error"),
            ("t3", "s", "WARNING", "  leading and trailing  ", "warning"),
            ("t4", "s", "SECURITY", "back\\slash NA", "security"),
            ("t5", "s", "INFO", None, "noise")]
    df = spark.createDataFrame(rows, LABELLED_LOG)
    logcsv.write_labelled_logs(df, f"{tmp}/csv")
    back = logcsv.read_labelled_logs(spark, f"{tmp}/csv")
    got = sorted(back.collect(), key=lambda r: r.timestamp)
    assert [r.message for r in got] == [r[3] for r in rows]
    assert logcsv.trainable(back).count() == 4


def test_classify_and_feedback(spark, tmp):
    """One request in, one result out with an id; the correction is stored."""
    req = spark.createDataFrame(
        [(7, '{"logs": [{"timestamp": "2031-01-05T23:59:01Z", "source": "pump-4", '
             '"level": "DEBUG", "message": "early round done, 40 trays counted"}]}')],
        "request_id long, payload string")
    lines = envelope.explode_requests(req)
    scored = score(lines.withColumn("log_id", F.sha2(F.concat_ws(":", "request_id", "pos"), 256)),
                   fixed_model(spark))
    results = envelope.collect_results(scored).collect()
    assert len(results) == 1 and len(results[0].results) == 1
    r = results[0].results[0]
    assert r.log_id and r.category == "noise" and isinstance(r.needs_review, bool)

    path = f"{tmp}/feedback"
    feedback_store.ensure_feedback_table(spark, path)
    fb = spark.createDataFrame([(r.log_id, "early round done, 40 trays counted", "noise", "warning")],
                               "log_id string, message string, predicted_category string, "
                               "true_category string")
    rejected = feedback_store.save_feedback(fb, path, batch=1)
    assert rejected.count() == 0
    stored = feedback_store.read_feedback(spark, path).collect()
    assert len(stored) == 1 and stored[0].log_id == r.log_id and stored[0].timestamp is not None


def test_feedback_replay_is_idempotent_and_nulls_rejected(spark, tmp):
    path = f"{tmp}/fb"
    feedback_store.ensure_feedback_table(spark, path)
    fb = spark.createDataFrame([("a", "m", "noise", "error"), ("a", "m", "noise", "warning"),
                                ("b", None, "noise", "noise")],
                               "log_id string, message string, predicted_category string, "
                               "true_category string")
    for _ in range(2):                       # the same batch delivered twice
        rejected = feedback_store.save_feedback(fb, path, batch=5)
    assert rejected.collect()[0].reason == "missing message"
    stored = feedback_store.read_feedback(spark, path)
    assert stored.count() == 2
    feedback_store.save_feedback(fb.limit(1), path, batch=6)
    assert feedback_store.read_feedback(spark, path).count() == 3
    latest = latest_feedback(feedback_store.read_feedback(spark, path).drop("batch"))
    assert latest.count() == 1


def test_replayed_batch_keeps_its_time_and_order(spark, tmp):
    schema = "log_id string, message string, predicted_category string, true_category string"
    path = f"{tmp}/fb"
    five = spark.createDataFrame([("a", "m", "noise", "error"), ("b", "m", "noise", "error"),
                                  ("b", "m", "noise", "warning")], schema).coalesce(1)
    six = spark.createDataFrame([("a", "m", "noise", "security")], schema)
    for batch, rows in ((5, five), (6, six), (5, five)):
        feedback_store.save_feedback(rows, path, batch)
    latest = {r.log_id: r.true_category for r in latest_feedback(feedback_store.read_feedback(spark, path)).collect()}
    assert latest == {"a": "security", "b": "warning"}


def test_model_store_round_trip(spark, tmp):
    m = fixed_model(spark)
    model_store.save_model(m, f"{tmp}/model")
    back = model_store.load_model(spark, f"{tmp}/model")
    assert back.classes == m.classes and back.intercepts == m.intercepts
    assert back.version == m.version and back.n_terms == m.n_terms
    m.version = None
    model_store.save_model(m, f"{tmp}/model2")
    assert model_store.load_model(spark, f"{tmp}/model2").version == "unknown"


def test_missing_model_is_fatal(spark, tmp):
    with pytest.raises(model_store.ModelLoadError):
        model_store.load_model(spark, f"{tmp}/nothing-here")


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_small_scans_are_dealt(spark, tmp):
    from logsift.sources.tables import read_table
    assert tasks_with_rows(read_table(spark, "/root/testdata/sf0.01", "labels")) == spark.sparkContext.defaultParallelism
    # One row group in several splits: all rows are in one of them.
    wide = spark.range(40_000, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x"))
    wide.write.option("compression", "none").parquet(f"{tmp}/one.parquet")
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "100k")
    try:
        raw = spark.read.parquet(f"{tmp}/one.parquet")
        assert raw.rdd.getNumPartitions() > 1 and tasks_with_rows(raw) == 1
        assert tasks_with_rows(read_table(spark, tmp, "one")) == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_large_scans_and_many_files_are_left(spark, tmp):
    from logsift.sources.tables import read_table
    n = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(n + 1).write.parquet(f"{tmp}/many.parquet")
    spark.range(100_000, numPartitions=1).write.parquet(f"{tmp}/large.parquet")
    assert "RoundRobin" not in read_table(spark, tmp, "many")._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        assert "RoundRobin" not in read_table(spark, tmp, "large")._jdf.queryExecution().executedPlan().toString()
        assert read_table(spark, tmp, "large").count() == 100_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_saving_without_pipeline_replaces_a_model_with_one(spark, tmp):
    class Pipeline:
        """Stands for a fitted pipeline: writes a folder that is none."""
        def write(self):
            return self

        def save(self, path):
            spark.range(1).write.parquet(path)

    model = fixed_model(spark)
    broken = TextModel(classes=model.classes, terms=model.terms, intercepts=model.intercepts, n_terms=model.n_terms,
                       version="broken", ngram_max=model.ngram_max, extra={"pipeline": Pipeline()})
    model_store.save_model(broken, f"{tmp}/m")
    with pytest.raises(model_store.ModelLoadError):
        model_store.load_model(spark, f"{tmp}/m")
    model_store.save_model(model, f"{tmp}/m")
    loaded = model_store.load_model(spark, f"{tmp}/m")
    assert "pipeline" not in loaded.extra and loaded.classes == list(model.classes)


def test_appended_file_is_read(spark, tmp):
    from logsift.plans import views
    one = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(10)
    one.write.parquet(f"{tmp}/d/events.parquet")
    assert views.logs(spark, f"{tmp}/d").count() == 10
    one.write.mode("append").parquet(f"{tmp}/d/events.parquet")
    assert views.logs(spark, f"{tmp}/d").count() == 20


def test_lines_are_split_and_bad_ones_kept(spark, tmp):
    good = ["t1,s,INFO,\"a, b\",noise", "t2,s,INFO,plain,noise", "t3,s,INFO,,noise"]
    bad = ["t4,s", "t5,s,INFO,m,noise,more", "no fields"]
    with open(f"{tmp}/logs.csv", "w") as f:
        f.write("timestamp,source,level,message,true_label\n" + "\n".join(good[:2] + bad + good[2:]) + "\n")
    read = logcsv.read_labelled_logs(spark, f"{tmp}/logs.csv", multi_line=False, keep_bad=True)
    fine, quarantined = logcsv.split_bad(read)
    assert sorted(r.timestamp for r in fine.collect()) == ["t1", "t2", "t3"]
    # Whatever columns are asked for.
    assert fine.count() == 3 and sorted(r[0] for r in fine.select("source").collect()) == ["s"] * 3
    assert sorted(r[0] for r in quarantined.collect()) == sorted(bad) and quarantined.count() == 3
    assert [r.message for r in fine.where("timestamp = 't1'").collect()] == ["a, b"]


def test_one_file_is_read_by_several_tasks(spark, tmp):
    with open(f"{tmp}/logs.csv", "w") as f:
        f.write("timestamp,source,level,message,true_label\n" + "".join(f"t{i},s,INFO,m{i},noise\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        read = logcsv.read_labelled_logs(spark, f"{tmp}/logs.csv", multi_line=False)
        assert tasks_with_rows(read) > 3 and read.select("timestamp").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
