"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import (exact_dedup, language_id, lexicon_bpe, line_dedup, minhash_tensor, mixing, prefix_trie, quality_rules,
                         secret_scan, token_alignment, token_ans, url_rules, warc)
from logsift.llm.common import keyed_rows
from logsift.llm.sql import ORACLE_SQL  # noqa: F401  (read by the entry module)

# Rows per Arrow batch: whole texts of some kilobytes each.
ARROW_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_copies(keyed_rows(table(spark, sf_dir, "documents")))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites: the documents' sources."""
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_lines", "n_removed", F.sha2("clean", 256).alias("clean_sha256"))


def op4_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (host: the source, no markup) and all pages (declared
    language and address); the text model learns from the documents' labels."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")
    model = language_id.fit(docs.select("lang", "text"))
    of_docs = docs.select(F.struct("doc_id", no_id.alias("page_id")).alias("key"), "text", none.alias("declared"),
                          F.col("source").alias("host"))
    of_pages = pages.select(F.struct(no_id.alias("doc_id"), "page_id").alias("key"),
                            language_id.visible_text(F.col("html")).alias("text"),
                            language_id.declared_language(F.col("html")).alias("declared"),
                            F.nullif(url_rules.host_of(F.col("url")), F.lit("")).alias("host"))
    return language_id.identify(of_docs.union(of_pages), model)


def op6_token_ans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ans.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("target", F.round("target", 6))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the document's source; repository: its part in one language."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), F.col("source"), F.struct("source", "lang"))


def op9_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = minhash_tensor.mark_near_copies(keyed_rows(table(spark, sf_dir, "documents")))
    return marked.select("doc_id", "n_shingles", "component_id", "kept")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page is blocked if the label of its id says toxic.  Every rule
    of enough support counts, on however few pages."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("blocked"))
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), labels, url_rules.Mining(min_pages=1))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"),
                                           tokenizer("byte_bpe_50k.tiktoken"), tokenizer("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_exact_dedup, op3_line_dedup, op4_lexicon_bpe,
                                   op5_language_id, op6_token_ans, op7_mixing, op8_secret_scan,
                                   op9_minhash_tensor, op10_url_rules, op11_token_alignment,
                                   op12_prefix_trie, op13_warc)}
