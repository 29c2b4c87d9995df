"""The training-data pipeline: quality rules, exact dedup, near dedup, mixing
and BPE encoding, each over what the stage before has kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import exact_dedup, lexicon_bpe, minhash_tensor, mixing, quality_rules
from logsift.llm.common import new_path
from logsift.llm.queries import table, tokenizer


# Words that a worker remembers; other stages run in the same workers.
MEMO = 150_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the row rules and whose host is not rejected."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the largest id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies: the smallest id."""
    return minhash_tensor.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_docs(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, ids`` and the digests of every document; the lexicon
    is compiled from the documents of this stage."""
    model = lexicon_bpe.fit(docs, tokenizer("byte_bpe_50k.json"), memo=MEMO)
    rows = docs.select("doc_id", "source", model.encode(F.col("text")).alias("ids"))
    rows = rows.select("doc_id", "source", "ids", model.decode(F.col("ids")).alias("decoded"))
    return rows.select("doc_id", "source", "ids", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix),
          ("BPE encoding", encode)]

# SQL has no merges of byte pairs; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
