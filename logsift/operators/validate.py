"""Projections and predicates on log records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.constants import REVIEW_THRESHOLD

REQUIRED = ["timestamp", "source", "level", "message"]


def mask_label(df: DataFrame, label: str = "true_label") -> DataFrame:
    """Drop the label before records are served; asserted on the schema."""
    out = df.drop(label)
    assert label not in out.columns
    return out


def with_validation(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """``is_valid`` and ``reason`` (first missing field, else null).

    Row level: one bad record is quarantined, the rest of the batch goes on.
    """
    reason = None
    for c in required:
        cond = F.col(c).isNull()
        reason = (F.when(cond, F.lit(f"missing {c}")) if reason is None
                  else reason.when(cond, F.lit(f"missing {c}")))
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def split_valid(df: DataFrame, required: list[str] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(valid records, quarantined records with a reason)."""
    v = with_validation(df, required)
    return (v.where("is_valid").drop("is_valid", "reason"),
            v.where(~F.col("is_valid")).drop("is_valid"))


def review_queue(scored: DataFrame, n: int = 15,
                 threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """The first ``n`` flagged results by time then id (a top-k)."""
    return (scored.where(F.col("confidence") < F.lit(threshold))
            .orderBy("timestamp", "log_id").limit(n))
