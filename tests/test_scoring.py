"""Relational scorer vs a brute-force Python scorer; plan shape."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logsift.functions.vectors import MAX_TERMS, Vocabulary
from logsift.plans import views
from logsift.plans.fixed_model import (FIXED_CLASSES, FIXED_INTERCEPTS, FIXED_TERMS,
                                       fixed_model)
from logsift.operators.score import TextModel, score
from tests.conftest import SF_SMALL
from tests.test_text import py_terms


def brute(message):
    table = {t[0]: t[1:] for t in FIXED_TERMS}
    tf = Counter(py_terms(message))
    x = {t: c * table[t][0] for t, c in tf.items() if t in table}
    norm = math.sqrt(sum(v * v for v in x.values()))
    m = []
    for k, b in enumerate(FIXED_INTERCEPTS):
        m.append(b + (sum(v * table[t][1 + k] for t, v in x.items()) / norm if norm else 0.0))
    s = [1 / (1 + math.exp(-v)) for v in m]
    p = [v / sum(s) for v in s]
    best = max(range(len(m)), key=lambda i: (m[i], -i))
    return FIXED_CLASSES[best], p[best]


def test_scorer_matches_brute_force(spark):
    lv = views.logs(spark, SF_SMALL)
    rows = score(lv, fixed_model(spark)).select("message", "category", "confidence").collect()
    assert len(rows) == lv.count()
    for r in rows:
        cat, conf = brute(r.message)
        assert r.category == cat
        assert abs(r.confidence - conf) < 1e-12


def test_record_without_known_terms_keeps_its_row(spark):
    df = spark.createDataFrame([(1, "zzz qqq"), (2, ""), (3, None), (4, "done")],
                               "rid long, message string")
    out = {r.rid: r for r in score(df, fixed_model(spark)).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[1].category == out[2].category == out[3].category == "noise"  # largest intercept
    assert out[4].category == "noise" and out[4].confidence > out[1].confidence


def test_filters_and_columns_reach_the_scan(spark):
    from logsift.plans import views as V
    plan = V.lifecycle(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan


def test_plan_has_no_exchange_and_no_join(spark):
    df = spark.range(10, numPartitions=2).select(F.col("id").cast("string").alias("message"))
    plan = score(df, fixed_model(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_repeated_and_null_keys_keep_their_rows(spark):
    rows = [("k", "early round done, 40 trays counted"), ("k", "guard called, cloned badge at yard gate"),
            (None, "bed-7 drifting, rising heat"), (None, "nothing known"), ("k", "nothing known")]
    df = spark.createDataFrame(rows, "rid string, message string")
    got = sorted((str(r.rid), r.message, r.category) for r in score(df, fixed_model(spark)).collect())
    assert got == sorted((str(k), m, brute(m)[0]) for k, m in rows)


def test_vocabulary_finds_every_term_and_no_other(spark):
    terms = [f"t{i}" for i in range(5000)] + ["", "\u00e9\u6771", 'a "b" \\ c', "x" * 5000]
    v = Vocabulary(terms, idf=[i / 7 for i in range(len(terms))])
    df = spark.createDataFrame([(t,) for t in terms] + [("t5000",), ("T1",), (None,)], "t string")
    got = [(r.t, r.i, r.x) for r in df.selectExpr("t", f"{v.number('t')} AS i").selectExpr("t", "i", f"{v.at('idf', 'i')} AS x").collect()]
    want = [(t, i, i / 7) for i, t in enumerate(terms)] + [(t, None, None) for t in ("t5000", "T1", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        Vocabulary(["x"] * (MAX_TERMS + 1))


def test_empty_model_decides_by_intercepts(spark):
    none = spark.createDataFrame([], "term string, idf double, w_0 double, w_1 double")
    m = TextModel(classes=["a", "b"], terms=none, intercepts=[0.0, 1.0], n_terms=0)
    assert [r.category for r in score(spark.createDataFrame([("x y",)], "message string"), m).collect()] == ["b"]
