"""A hot key holding a third of all rows: results stay whole and exact."""

from pyspark.sql import functions as F

from logsift.operators import feedback, metrics


def test_hot_log_id_in_feedback(spark):
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("log_id"),
        F.col("id").alias("id"), F.lit("m").alias("message"),
        F.lit("noise").alias("predicted_category"),
        F.when(F.col("id") % 2 == 0, F.lit("noise")).otherwise(F.lit("error")).alias("true_category"),
        F.timestamp_seconds(F.col("id") % 7).alias("timestamp"))
    latest = {r.log_id: r for r in feedback.latest_feedback(df).collect()}
    assert len(latest) == 1 + (n - n // 3)
    hot_ids = [i for i in range(n) if i % 3 == 0]
    best = max(hot_ids, key=lambda i: (i % 7, i))
    assert latest["hot"].id == best
    scored = df.select("log_id", F.lit(True).alias("needs_review"))
    assert feedback.review_backlog(scored, df.where(F.col("log_id") != "hot")).count() == n // 3


def test_hot_minute_in_rolling_mean(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.lit(60)))
        .otherwise(F.timestamp_seconds(F.col("id") * 60)).alias("event_time"),
        (F.col("id") % 10 / 10.0).alias("confidence"))
    out = metrics.rolling_mean(df)
    assert out.agg(F.sum("n")).collect()[0][0] == 5 * n
