"""Cumulative histograms with inclusive upper bounds, in one pass.

``histogram_rows(df, value, bounds, metric)`` returns rows
``(metric, le, value)`` for every bound and ``+Inf`` plus ``<metric>_sum``
and ``<metric>_count`` rows (le null), the shape of a scraped histogram.
One aggregate with ``count_if`` per bound: map-side partial aggregation
shrinks every partition to one row before the single-row final merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound_label(b: float) -> str:
    return repr(float(b))


def bound_columns(value: Column, bounds: list[float], prefix: str = "") -> list[Column]:
    """Aggregates of one pass: records up to each bound, all, and their sum."""
    cols = [F.count_if(value <= F.lit(b)).alias(f"{prefix}le_{i}") for i, b in enumerate(bounds)]
    return [*cols, F.count(value).alias(f"{prefix}le_inf"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{prefix}sum"),
            F.count(value).alias(f"{prefix}count")]


def histogram_entries(metric: str, bounds: list[float], prefix: str = "", labels: bool = False) -> list[Column]:
    """The rows of a histogram as structs over ``bound_columns``."""
    none = F.lit(None).cast("string")
    rows = [(f"{metric}_bucket", F.lit(bound_label(b)), f"le_{i}") for i, b in enumerate(bounds)]
    rows += [(f"{metric}_bucket", F.lit("+Inf"), "le_inf"), (f"{metric}_sum", none, "sum"), (f"{metric}_count", none, "count")]
    return [F.struct(F.lit(name).alias("metric"), *[F.lit("{}").alias("labels")] * labels, le.alias("le"),
                     F.col(prefix + c).cast("double").alias("value")) for name, le, c in rows]


def histogram_rows(df: DataFrame, value: Column | str, bounds: list[float],
                   metric: str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return df.agg(*bound_columns(v, bounds)).select(F.inline(F.array(*histogram_entries(metric, bounds))))
