"""Exact quantiles against sorting."""

import math

import pytest

from logsift.operators import metrics
from logsift.operators.metrics import exact_quantile, exact_quantiles, latency_percentiles


@pytest.mark.parametrize("values", [
    [], [None, None], [3.0], [1.0] * 50 + [2.0], [float(i * i) for i in range(3000)],
    [-1e308, 1e308, 0.0, 5e-324, -5e-324], [10.0 ** k for k in range(-300, 300)],
    [None, float("nan"), float("inf"), 1.0, 2.0, 3.0],
])
def test_equals_sorting(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    kept = sorted(v for v in values if v is not None and math.isfinite(v))
    for p in (0.0, 0.9, 1.0):
        want = kept[max(1, math.ceil(p * len(kept))) - 1] if kept else None
        assert exact_quantile(df, "x", p) == want


def test_exact_on_many_rows_in_three_passes(spark, monkeypatch):
    df = spark.range(3_000_000).selectExpr("pmod(id * 7919, 3000000) / 7e0 as latency_s")
    passes, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: passes.append(1) or collect(self))
    got = exact_quantiles(df, "latency_s", [0.9, 0.95])
    assert got == [2699999 / 7.0, 2849999 / 7.0] and len(passes) <= 3
    monkeypatch.undo()
    assert tuple(latency_percentiles(df.limit(1000)).first()) == tuple(exact_quantiles(df.limit(1000), "latency_s", [0.9, 0.95]))


def test_refined_where_a_range_holds_too_much(spark, monkeypatch):
    monkeypatch.setattr(metrics, "GATHER_VALUES", 3)
    df = spark.range(5000).selectExpr("pmod(id * 7919, 5000) / 3e0 as x")
    shares = [0.0, 0.1, 0.5, 0.501, 0.9, 0.95, 1.0]
    want = [sorted(i / 3 for i in range(5000))[max(1, math.ceil(p * 5000)) - 1] for p in shares]
    assert exact_quantiles(df, "x", shares, accuracy=20) == want
