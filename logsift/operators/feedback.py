"""Reading reviewer feedback back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_feedback(fb: DataFrame) -> DataFrame:
    """the latest correction per record, by timestamp, position in its
    batch (where the table has one) and id.  ``max_by`` keeps one candidate per record per partition before the shuffle, so a
    record with very many corrections does not skew."""
    cols = [c for c in fb.columns if c != "log_id"]
    best = F.max_by(F.struct(*cols), F.struct(*[c for c in ("timestamp", "position", "id") if c in cols]))
    return fb.groupBy("log_id").agg(best.alias("_b")).select("log_id", "_b.*")


def correction_rate(fb: DataFrame) -> DataFrame:
    """share of reviewed predictions that the reviewer changed, per
    predicted category."""
    changed = F.col("predicted_category") != F.col("true_category")
    return fb.groupBy("predicted_category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(changed).alias("n_corrected"),
        F.avg(changed.cast("double")).alias("correction_rate"))


def correction_pairs(fb: DataFrame) -> DataFrame:
    """F1 by predicted and true category: reviewed records of each pair and
    their share of the predicted category; the window runs over the pairs."""
    pairs = fb.groupBy("predicted_category", "true_category").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("predicted_category")))


def retraining_set(train: DataFrame, latest: DataFrame) -> DataFrame:
    """training rows plus corrected records, the correction as label."""
    a = train.select("message", F.col("true_label").alias("label"),
                     F.lit("train").alias("origin"))
    b = latest.select("message", F.col("true_category").alias("label"),
                      F.lit("feedback").alias("origin"))
    return a.unionByName(b)


def open_records(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """F4 where records and their feedback come as one table of ``(log_id,
    category, confidence, entry)``, ``entry`` null for a record: one aggregate
    instead of an anti join, so both come from one pass."""
    fed = F.count(entry).alias("fed")
    return (entries.groupBy("log_id", "category", "confidence").agg(fed).where("fed = 0")
            .select("log_id", "category", "confidence"))


def review_backlog(scored: DataFrame, fb: DataFrame) -> DataFrame:
    """flagged records that have no feedback yet.  The feedback keys are
    de-duplicated first (partial aggregation), then an anti join."""
    seen = fb.select("log_id").distinct()
    return scored.where(F.col("needs_review")).join(seen, "log_id", "left_anti")
