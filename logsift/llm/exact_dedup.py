"""Exact deduplication by deterministic block naming (operator 2).

A text is cut into blocks of fixed size.  The distinct blocks of the corpus
are sorted and numbered; a document becomes a sequence of block names.  Then
adjacent names are paired, the distinct pairs are sorted and numbered in turn,
and so on until every document is one name: its identity, equal for two
documents exactly when their texts are equal.

Blocks travel under a 128-bit key; the keys are checked on the whole set of
distinct blocks to belong to one block each (a collision makes the naming
start again with another seed), so names are free of collisions by check, not
by chance.  Texts cross the network once, after map-side removal of repeated
blocks; everything after that works on integers.

Defined cases: a null text counts as empty; empty texts are equal to each
other; of equal texts the row with the largest ``doc_id`` stays (null ids are
the smallest; of rows that share that id one stays); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import keep_rows, keyed_rows, saved, text_of

BLOCK = 4096
MAX_SEEDS = 8


def block_key(block: Column, seed: int) -> Column:
    """128-bit routing key of a block."""
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("a"),
                    F.xxhash64(F.lit(2 * seed + 1), block).alias("b"))


def _blocks(text: Column, size: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _names(distinct: DataFrame, columns: list[str]) -> DataFrame:
    """Number the sorted distinct rows; written, so that a name never changes."""
    return saved(distinct.orderBy(*columns).withColumn("name", F.monotonically_increasing_id()), "names")


def _first_level(rows: DataFrame, text: str, size: int, key: Callable[[Column, int], Column]
                 ) -> tuple[DataFrame, DataFrame]:
    """``(documents with block keys, names of the keys)``."""
    blocks = _blocks(text_of(F.col(f"doc.`{text}`")), size)
    for seed in range(MAX_SEEDS):
        distinct = (rows.select(F.explode(blocks).alias("block"))
                    .select(key(F.col("block"), seed).alias("k"), "block")
                    .groupBy("k.a", "k.b", "block").count())
        keys = saved(distinct.groupBy("a", "b").agg(F.count("*").alias("n")), "keys")
        if keys.filter("n > 1").isEmpty():
            docs = rows.select("row_file", "row_no", F.monotonically_increasing_id().alias("rid"),
                               F.col("doc.doc_id").alias("doc_id"),
                               F.sha2(text_of(F.col(f"doc.`{text}`")), 256).alias("text_sha256"),
                               F.transform(blocks, lambda x: key(x, seed)).alias("ks"))
            return saved(docs, "docs"), _names(keys.select("a", "b"), ["a", "b"])
    raise RuntimeError("no collision-free block key found")


def identities(rows: DataFrame, text: str = "text", size: int = BLOCK,
               key: Callable[[Column, int], Column] = block_key) -> tuple[DataFrame, DataFrame]:
    """``(docs: row key, rid, doc_id, text_sha256; ids: rid, level, name)``."""
    docs, names = _first_level(rows, text, size, key)
    parts = (docs.select("rid", F.size("ks").alias("left"), F.posexplode("ks").alias("pos", "k"))
             .select("rid", "left", "pos", "k.a", "k.b"))
    level = 0
    cur = saved(parts.join(names, ["a", "b"]).select("rid", "left", "pos", "name"), "level0")
    done = cur.filter("left = 1").select("rid", F.lit(0).alias("level"), "name")
    while not cur.filter("left > 1").isEmpty():
        level += 1
        half = F.shiftright("pos", 1)
        even = (F.col("pos") % 2) == 0
        pairs = (cur.filter("left > 1")
                 .groupBy("rid", half.alias("pos"), F.shiftright(F.col("left") + 1, 1).alias("left"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("l"),
                      F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r")))
        pairs = saved(pairs, "pairs")
        named = _names(pairs.select("l", "r").distinct(), ["l", "r"])
        cur = saved(pairs.join(named, ["l", "r"]).select("rid", "left", "pos", "name"), "level")
        done = done.union(cur.filter("left = 1").select("rid", F.lit(level).alias("level"), "name"))
    return docs, done


def mark_copies(rows: DataFrame, text: str = "text", size: int = BLOCK,
                key: Callable[[Column, int], Column] = block_key) -> DataFrame:
    """One row per document: its row key, ``doc_id, keep_id, group_size, kept,
    text_sha256``."""
    docs, ids = identities(rows, text, size, key)
    member = saved(ids.join(docs.select("rid", "doc_id"), "rid"), "members")
    groups = (member.groupBy("level", "name")
              .agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")))
    out = (member.join(groups, ["level", "name"])
           .select("rid", "keep", "group_size")
           .join(docs.select("rid", "row_file", "row_no", "doc_id", "text_sha256"), "rid"))
    return out.select("row_file", "row_no", "doc_id", F.col("keep.doc_id").alias("keep_id"),
                      "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of every group of equal texts."""
    rows = keyed_rows(docs)
    return keep_rows(rows, mark_copies(rows, text).filter("kept"))
