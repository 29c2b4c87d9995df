"""MinHash near-dedup with tensored banding (operator 9).

A document is the set of its distinct five-word shingles.  Two collections of
``TABLES`` sub-hashes (two minhashes each) give ``TABLES`` squared tables,
keyed by one sub-hash of each collection: 48 minhashes do the work of 576.
Sub-hashes that no other document shares are left out before the keys are
formed, which loses no key that two documents share.

Candidates are confirmed on full sets, without forming all pairs of a bucket:

1. documents of the same set are one class with one representative;
2. a document with more than a quarter of its shingles in no other candidate
   can have no link and goes;
3. every bucket compares its members with one member, the one that shares
   most; links found so far are joined into components;
4. two members that step 3 left in different components are compared only if
   a link is still possible: the difference of their distances to the common
   member is within the threshold (Jaccard distance is a metric), and their
   shared shingles, counted in ``BINS`` bins, can overlap enough.  Both tests
   are exact bounds.

The buckets miss a pair whose similarity is exactly 0.75 with a probability of
1e-4, and fewer above (at 0.85: 4e-7); every other step is exact.

Defined cases: a null, empty or wordless text has an empty set and no links;
with fewer than five words the whole sequence is the one shingle; repeated
rows are copies, one of them stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import keep_rows, keyed_rows, saved
from logsift.llm.components import components

WIDTH, TABLES, BINS = 5, 12, 64
PERCENT = 75
_RNG = np.random.default_rng(20)
_MIX = _RNG.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 2**63, 4 * TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, 4 * TABLES, dtype=np.uint64)
_PAIR = np.uint64(0x9E3779B97F4A7C15)

LONGS = T.ArrayType(T.LongType())
SIGNED = T.StructType([T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()),
                       T.StructField("f2", T.LongType()), T.StructField("g1", LONGS), T.StructField("g2", LONGS)])


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    # bytes.lower() lowers A-Z only, bytes.split() splits at the six ASCII
    # white spaces.
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WIDTH + 1
    total = h[:n] * _MIX[0]
    for i in range(1, WIDTH):
        total += h[i:i + n] * _MIX[i]
    return np.unique(_scramble(total))


def signature(s: np.ndarray) -> tuple[int, int, int, list[int], list[int]]:
    """Size, fingerprint and the two collections of sub-hashes of a set."""
    if not len(s):
        return 0, 0, 0, [], []
    least = np.full(4 * TABLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(least, (s[i:i + 4096, None] * _A + _B).min(axis=0), out=least)
    sub = _scramble(least[0::2] * _PAIR + least[1::2]).view(np.int64)
    f = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return len(s), int(f[0]), int(f[1]), sub[:TABLES].tolist(), sub[TABLES:].tolist()


@F.pandas_udf(SIGNED)
def sign(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([signature(shingles(t)) for t in text], columns=SIGNED.names)


@F.pandas_udf(LONGS)
def shingle_set(text: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def bin_counts(sets: pd.Series, own: pd.Series) -> pd.Series:
    """Counts by bin of the shingles of a set that are not its own alone."""
    shared = (np.setdiff1d(s, o, assume_unique=True) for s, o in zip(sets, own))
    return pd.Series([np.bincount((x >> 20) % BINS, minlength=BINS) for x in shared], dtype=object)


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once; a shuffle join, skew is split."""
    often = rows.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").select(key)
    return rows.join(often, key, "left_semi")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """``(key, cid)`` of the tensored tables, keys with two members or more."""
    def slots(g: str, side: int) -> Column:
        return F.transform(F.col(g), lambda h, i: F.struct(
            F.lit(side).alias("side"), i.alias("i"), h.alias("h"), F.xxhash64(F.lit(side), i, h).alias("sub")))

    subs = classes.select("cid", F.explode(F.concat(slots("g1", 0), slots("g2", 1))).alias("s")).select("cid", "s.*")
    live = (_repeated(subs, "sub").groupBy("cid")
            .agg(F.collect_list(F.when(F.col("side") == 0, F.struct("i", "h"))).alias("x"),
                 F.collect_list(F.when(F.col("side") == 1, F.struct("i", "h"))).alias("y")))
    keys = (live.filter((F.size("x") > 0) & (F.size("y") > 0))
            .select("cid", "y", F.explode("x").alias("x")).select("cid", "x", F.explode("y").alias("y"))
            .select(F.xxhash64("x.i", "x.h", "y.i", "y.h").alias("key"), "cid"))
    return saved(_repeated(keys, "key"), "buckets")


def linked(inter: Column, n: Column, m: Column) -> Column:
    return 100 * inter >= PERCENT * (n + m - inter)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the size of the intersection of their full sets."""
    s = sets.select("cid", "n", "s")
    left = s.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    right = s.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))
    out = pairs.join(left, "a").join(right, "b")
    return saved(out.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("inter")),
                 "verified")


def candidate_sets(rows: DataFrame, signed: DataFrame, buckets: DataFrame, text: str) -> DataFrame:
    """``cid, n, s, alone, bins``: full sets of the bucket members; ``alone``
    counts the shingles in no other member, ``bins`` the others by bin.
    Members that can have no link are left out."""
    members = signed.filter("cid = rid").join(buckets.select("cid").distinct(), "cid", "left_semi")
    keys = members.select("row_file", "row_no", "cid", "n").hint("shuffle_hash")
    sets = rows.select("row_file", "row_no", F.col(f"doc.`{text}`").cast("string").alias("t"))
    sets = saved(sets.join(keys, ["row_file", "row_no"]).select("cid", "n", shingle_set("t").alias("s")), "sets")
    single = (sets.select("cid", F.explode("s").alias("x")).groupBy("x")
              .agg(F.count("*").alias("c"), F.min("cid").alias("cid")).filter("c = 1"))
    alone = single.groupBy("cid").agg(F.collect_list("x").alias("own"))
    sets = sets.join(alone, "cid", "left").withColumn("own", F.coalesce("own", F.array().cast("array<long>")))
    sets = sets.withColumn("alone", F.size("own")).filter(4 * F.col("alone") <= F.col("n"))
    return saved(sets.select("cid", "n", "s", "alone", bin_counts("s", "own").alias("bins")), "shared")


def links(rows: DataFrame, signed: DataFrame, text: str = "text") -> DataFrame:
    """``(node, comp)`` of classes that are linked to a smaller one."""
    classes = signed.filter("cid = rid")
    buckets = bucket_rows(classes)
    sets = candidate_sets(rows, signed, buckets, text)
    weight = sets.select("cid", (1000 * F.col("alone") / F.col("n")).cast("int").alias("w"))
    members = buckets.join(weight, "cid")
    centre = members.groupBy("key").agg(F.min(F.struct("w", "cid")).alias("c")).select("key", F.col("c.cid").alias("centre"))
    pairs = saved(members.join(centre, "key").filter("cid <> centre")
                  .select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    star = verified(pairs, sets)
    found = star.filter(linked(F.col("inter"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    first = components(found)
    more = verified(open_pairs(star, sets, first), sets)
    more = more.filter(linked(F.col("inter"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    if more.isEmpty():
        return first
    return components(first.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))


def open_pairs(star: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs under the same centre, in different components, that the two
    bounds do not exclude.  One side was not linked to its centre."""
    distance = 1 - F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))
    under = star.select(F.col("a").alias("centre"), F.col("b").alias("cid"), distance.alias("d"))
    label = comps.select(F.col("node").alias("cid"), "comp")
    under = under.join(label, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    at = comps.select(F.col("node").alias("centre"), F.col("comp").alias("centre_comp"))
    under = under.join(at, "centre", "left").withColumn("centre_comp", F.coalesce("centre_comp", "centre"))
    under = saved(under.withColumn("open", F.col("comp") != F.col("centre_comp"))
                  .join(sets.select("cid", "n", "bins"), "cid"), "under")
    # Centres whose members are all in the centre's component are done.
    pending = saved(under.filter("open").select("centre").distinct(), "pending")
    under = under.join(pending, "centre", "left_semi")
    x, z = under.filter("open").alias("x"), under.alias("z")
    most = F.aggregate(F.zip_with("x.bins", "z.bins", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    possible = ((F.col("x.centre") == F.col("z.centre")) & (F.col("x.comp") != F.col("z.comp"))
                & (~F.col("z.open") | (F.col("x.cid") < F.col("z.cid")))
                & (F.abs(F.col("x.d") - F.col("z.d")) <= 1 - PERCENT / 100 + 1e-9)
                & linked(F.least("x.n", "z.n"), F.col("x.n"), F.col("z.n"))
                & linked(most, F.col("x.n"), F.col("z.n")))
    return saved(x.join(z, possible).select(F.least("x.cid", "z.cid").alias("a"),
                                            F.greatest("x.cid", "z.cid").alias("b")).distinct(), "open")


def mark_near_copies(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: its row key, ``doc_id, n_shingles, component_id,
    kept``; of a component the document with the smallest id stays."""
    t = F.col(f"doc.`{text}`").cast("string")
    signed = rows.select("row_file", "row_no", F.monotonically_increasing_id().alias("rid"),
                         F.col("doc.doc_id").alias("doc_id"), sign(t).alias("s"))
    signed = saved(signed.select("row_file", "row_no", "rid", "doc_id", "s.*"), "signed")
    full = signed.filter("n > 0")
    classes = full.groupBy("f1", "f2", "n").agg(F.min("rid").alias("cid"))
    full = saved(full.join(classes, ["f1", "f2", "n"]), "classes")
    comps = links(rows, full, text).withColumnRenamed("node", "cid")
    small = full.select("row_file", "row_no", "rid", "doc_id", "n", "cid")
    placed = small.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).drop("cid")
    empty = signed.filter("n = 0").select("row_file", "row_no", "rid", "doc_id", "n", F.col("rid").alias("comp"))
    placed = saved(placed.select(empty.columns).union(empty), "placed")
    first = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    return placed.join(first, "comp").select(
        "row_file", "row_no", "doc_id", F.col("n").alias("n_shingles"),
        F.col("first.doc_id").alias("component_id"), (F.col("rid") == F.col("first.rid")).alias("kept"))


def near_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of every component of near copies."""
    rows = keyed_rows(docs)
    return keep_rows(rows, mark_near_copies(rows, text).filter("kept"))
