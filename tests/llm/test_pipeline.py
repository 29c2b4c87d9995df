"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logsift.llm import mixing
from logsift.llm.common import saved
from logsift.llm.queries import tokenizer
from tests.conftest import SF_SMALL
from tests.llm.test_brute import brute_counts, brute_near


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF_SMALL), "stage")
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality(steps):
    def good(r):
        n, _, _, _, repeated = brute_counts(r.text)
        return n >= 10 and 100 * repeated <= 20 * n
    assert Counter(steps[1].collect()) == Counter(r for r in steps[0].collect() if good(r))


def test_exact(steps):
    last = {}
    for r in steps[1].collect():
        if r.text not in last or last[r.text].doc_id < r.doc_id:
            last[r.text] = r
    assert Counter(steps[2].collect()) == Counter(last.values())


def test_near(steps):
    want = {least for _, _, least in brute_near(steps[2].collect())}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(want)


def test_mix(steps):
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix(steps[3]).collect()}
    got = Counter(r.doc_id for r in steps[4].collect())
    assert got == Counter({d: n for d, n in want.items() if n})


def test_encode(steps):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = Counter((r.doc_id, np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()) for r in steps[4].collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in steps[5].collect()) == want


def test_stages_of_nothing(spark, steps):
    docs = saved(steps[0].limit(0), "nothing")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF_SMALL), "stage")
        assert docs.count() == 0


def test_stages_with_odd_rows(spark, odd):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("w"), F.col("id"), F.lit("x"), k)))
    good = spark.range(1000, 1090).select(
        F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
        F.lit(1).cast("long").alias("n_chars"), F.lit(1).cast("long").alias("kept"), F.lit("h").alias("host"), F.lit("n").alias("name"))
    docs = saved(odd.union(good), "odd")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF_SMALL), "stage")
    assert docs.count() > 0
