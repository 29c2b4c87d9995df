"""Evaluation (E1-E5) of scored records against their labels.

Only the confusion counts touch the records (one aggregate, partial
aggregation map-side); everything after works on at most K x K rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.constants import REVIEW_THRESHOLD


def confusion(scored: DataFrame, truth: str = "true_label", pred: str = "category") -> DataFrame:
    """(true_label, category, n)."""
    return scored.groupBy(F.col(truth).alias("true_label"),
                          F.col(pred).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _zero_div(num, den):
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def class_report(scored: DataFrame, truth: str = "true_label", pred: str = "category") -> DataFrame:
    """(label, precision, recall, f1, support); labels are the union of
    true and predicted classes, a zero denominator gives 0."""
    conf = confusion(scored, truth, pred)
    per_true = conf.groupBy(F.col("true_label").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("true_label") == F.col("category"), F.col("n")).otherwise(0)).alias("tp"))
    per_pred = conf.groupBy(F.col("category").alias("label")).agg(F.sum("n").alias("predicted"))
    rep = per_true.join(per_pred, "label", "full_outer").select(
        "label",
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    p = _zero_div(F.col("tp").cast("double"), F.col("predicted").cast("double"))
    r = _zero_div(F.col("tp").cast("double"), F.col("support").cast("double"))
    rep = rep.select("label", "support", "tp", p.alias("precision"), r.alias("recall"))
    f1 = _zero_div(F.lit(2.0) * F.col("precision") * F.col("recall"),
                   F.col("precision") + F.col("recall"))
    return rep.select("label", "precision", "recall", f1.alias("f1"),
                      F.col("support").cast("long").alias("support"), "tp")


def report_averages(report: DataFrame) -> DataFrame:
    """Accuracy, macro average and support-weighted average rows."""
    total = F.sum("support")
    agg = report.agg(
        (F.sum("tp") / total).alias("accuracy"),
        F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("w_r"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("w_f1"),
        total.cast("long").alias("support"))
    rows = [
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"),
                 F.col("support").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("macro_p").alias("precision"),
                 F.col("macro_r").alias("recall"), F.col("macro_f1").alias("f1"),
                 F.col("support").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("w_p").alias("precision"),
                 F.col("w_r").alias("recall"), F.col("w_f1").alias("f1"),
                 F.col("support").alias("support")),
    ]
    return agg.select(F.inline(F.array(*rows)))


def low_confidence(scored: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """(low_confidence, total), strict ``<``."""
    return scored.agg(F.count_if(F.col("confidence") < F.lit(threshold)).alias("low_confidence"),
                      F.count(F.lit(1)).alias("total"))


def review_gate(scored: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """E5: the gate passes when at least one prediction is low-confidence."""
    return low_confidence(scored, threshold).withColumn("passed", F.col("low_confidence") > 0)


def label_index(df: DataFrame, label: str) -> DataFrame:
    """M1: (class, label_index, n), classes in alphabetical order from 0.
    The window runs over the per-class table (one row per class)."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("class", (F.row_number().over(Window.orderBy("class")) - 1)
                         .alias("label_index"), "n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M2: balanced weights N / (K * n_class) as (class, n, weight)."""
    counts = df.groupBy(F.col(label).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()   # over the per-class table only
    n_all = F.sum("n").over(whole)
    k = F.count(F.lit(1)).over(whole)
    return counts.select("class", "n", (n_all / (k * F.col("n"))).alias("weight"))
