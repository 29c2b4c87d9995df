"""Tokenizer, n-grams and in-row term counts against plain Python."""

import pyarrow as pa
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.functions.text import ngrams, term_counts, tokens
from logsift.operators import features

PY_TOKEN = re.compile(r"(?u)\b\w\w+\b")


def py_terms(text):
    toks = PY_TOKEN.findall(text.lower()) if text is not None else []
    return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]


CASES = ["", "one", "Hello World", "a b c", "naïve café Über straße", "x_y 12 3 ab-cd",
         "Ünïcode ÉCOLE élève", "tab\tand\nnewline  spaces", None]


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id int, text string")
    out = df.select("id", ngrams(tokens(F.col("text"))).alias("t")).collect()
    for r in out:
        assert list(r.t) == py_terms(CASES[r.id]), CASES[r.id]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a1", "b2", "c3", "dd", "é9"]), max_size=30))
def test_term_counts_property(spark, words):
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    got = term_counts(df, ngrams(tokens(F.col("text"))), "c").select("c").collect()[0].c
    assert {x.term: x.tf for x in got} == dict(Counter(py_terms(" ".join(words))))
    assert [x.term for x in got] == sorted(x.term for x in got)


@pytest.mark.parametrize("text", ["solo", ""])
def test_short_messages_do_not_fail(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(ngrams(tokens(F.col("text"))).alias("t")).collect()[0].t == py_terms(text)


ODD = [None, "", " ", "a", "a b c", "One", "one ONE one", "a bb a cc", "İstanbul ΣΑΣ Straße", "東京 ١٢٣ x٣ é̃ \U00010400\U00010401 \U00010400",
       "_ __ ___", "x-y xx--yy\nzz\tzz", "no.1 no1 №1 ½ ½½ Ⅳx", "it's we'll", " nb sp em", "\x00nul\x00nul", "word " * 3000]


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 8 << 20])
def test_counts_by_arrow_equal_counts_by_expressions(spark, monkeypatch, chunk):
    texts = pa.array([r.r for r in spark.createDataFrame([(t,) for t in ODD], "t string").select(features.spaced_tokens("t").alias("r")).collect()])
    monkeypatch.setattr(features, "CHUNK", chunk)
    every = features.np.ones(features.TERM_BUCKETS, bool)
    want = features.counted(spark.createDataFrame([(t,) for t in ODD], "text string").coalesce(1)).collect()
    assert features.counted_rows(texts, every, 2).to_pylist() == [[c.asDict() for c in r.counts] for r in want]
    assert features.counted_rows(texts[:0], every, 2).to_pylist() == []


@pytest.mark.parametrize("k", [1, 7, 40, 5000])
@pytest.mark.parametrize("spare", [0.2, 4])
def test_frequent_counts_hold_the_vocabulary(spark, monkeypatch, k, spare):
    """Whether the first buckets are enough or, with few, a second turn is
    needed; rows without a key and repeated keys count as before."""
    rows = [(None if i % 7 == 3 else i // 2, t, i % 3) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    monkeypatch.setattr(features, "SPARE", spare)
    counts, dfreq = features.frequent_counts(docs, k=k, fit_on="part < 2")
    full = features.doc_freq(features.term_freq(docs.where("part < 2")))
    assert values(features.vocabulary(dfreq, k)) == values(features.vocabulary(full, k))
    assert counts.count() == len(rows) and "text" not in counts.columns
    empty, none = features.frequent_counts(docs.limit(0), k=k)
    assert empty.count() == none.count() == 0


def test_few_terms_are_counted_for_a_vocabulary(spark):
    """Words that occur once, and their pairs, are not counted by term."""
    texts = ["often seen " + " ".join(f"w{i}x{j}" for j in range(400)) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, dfreq = features.frequent_counts(docs, k=3)
    assert dfreq.count() < 2000
    assert [r.term for r in features.vocabulary(dfreq, 3).orderBy("rank").collect()][:2] == ["often", "often seen"]
