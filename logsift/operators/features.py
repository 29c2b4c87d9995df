"""Text features (T1-T8): counts, vocabulary, smoothed IDF, L2 TF-IDF.

Plan notes:

* A document's counted terms are one array in its row (``counted``: sorted
  runs); ``term_freq`` is that array in long form.  Both are narrow.
* ``doc_freq`` is the one aggregate keyed by term; partial aggregation
  map-side turns every partition into at most one row per term before the
  shuffle, so very frequent terms ("the", "de") do not skew it.
* ``vocabulary`` is a top-k (``TakeOrderedAndProject``): every partition
  keeps its best ``k`` rows, no global sort.  Its size is bounded by ``k``, so
  ``fit`` may bring it to the driver.
* ``frequent_counts`` counts only what can be in a vocabulary: few terms instead
  of all pairs of words of the corpus reach ``doc_freq`` and its shuffle.
* ``tfidf`` builds and norms a document's vector inside its row and explodes it
  at the end: no join, no shuffle by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.constants import MAX_FEATURES, NGRAM_MAX
from logsift.functions.text import TOKEN_PATTERN, ngrams, term_counts, tokens
from logsift.functions.vectors import Vocabulary, norm
from logsift.session import stored


def tokenize(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """T1."""
    return df.withColumn(out, tokens(F.col(text)))


def with_ngrams(df: DataFrame, text: str = "text", out: str = "terms",
                max_n: int = NGRAM_MAX) -> DataFrame:
    """Unigrams then bigrams of the token list."""
    return df.withColumn("_toks", tokens(F.col(text))).withColumn(
        out, ngrams(F.col("_toks"), max_n)).drop("_toks")


def counted(df: DataFrame, text: str = "text", max_n: int = NGRAM_MAX) -> DataFrame:
    """``df`` with ``counts`` instead of the text: its terms with their raw
    counts, ``array<struct<term, tf>>``."""
    terms = with_ngrams(df, text, "_terms", max_n)
    return term_counts(terms, F.col("_terms"), "counts").drop("_terms", text)


def long_form(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf) of counted rows."""
    # The outer generator: the optimizer infers no ``size(...) > 0`` filter
    # for it, which it would otherwise push below the projections with the
    # whole counting expression inlined.
    return counts.select(key, F.inline_outer("counts")).where(F.col("term").isNotNull())


def term_freq(df: DataFrame, key: str = "doc_id", text: str = "text",
              max_n: int = NGRAM_MAX) -> DataFrame:
    """(key, term, tf) raw counts, computed per row."""
    return long_form(counted(df.select(key, text), text, max_n), key)


def doc_freq(tf: DataFrame, key: str = "doc_id") -> DataFrame:
    """T4: (term, cf, df): corpus frequency and document frequency."""
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"),
                                  F.count(F.col(key)).alias("df"))


def vocabulary(dfreq: DataFrame, k: int = MAX_FEATURES) -> DataFrame:
    """T5: the ``k`` terms of highest corpus frequency, ties by term."""
    top = dfreq.orderBy(F.desc("cf"), F.asc("term")).limit(k)
    # A window over at most k rows (after the top-k), to number them.
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("cf"), F.asc("term"))))


def smoothed_idf(df_col: Column, n_docs: Column) -> Column:
    """ln((1 + N) / (1 + df)) + 1."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def idf_table(dfreq: DataFrame, n_docs: int | Column, k: int = MAX_FEATURES) -> DataFrame:
    """(term, df, idf) for the vocabulary; ``n_docs`` is the number of
    training documents, a number or a scalar-subquery column
    (``docs.select(count(1)).scalar()``), which keeps the plan lazy."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))
    vocab = vocabulary(dfreq, k)
    return vocab.select("term", "df", smoothed_idf(F.col("df"), n.cast("double")).alias("idf"))


def fit(counts: DataFrame, k: int = MAX_FEATURES, key: str = "doc_id") -> Vocabulary:
    """Vocabulary and smoothed IDF (column ``idf``) of counted documents; at
    most ``k`` terms reach the driver."""
    return fit_frequencies(doc_freq(long_form(counts, key), key), counts.count(), k)


def fit_frequencies(dfreq: DataFrame, n_docs: int, k: int = MAX_FEATURES) -> Vocabulary:
    """``fit`` on document frequencies."""
    terms, idf = ranked_idf(dfreq, n_docs, k)
    return Vocabulary(terms, idf=idf)


def fitted_idf(tf: DataFrame, n_docs: int, k: int = MAX_FEATURES, key: str = "doc_id") -> tuple[list[str], list[float]]:
    """(terms in rank order, their IDF)."""
    return ranked_idf(doc_freq(tf, key), n_docs, k)


def ranked_idf(dfreq: DataFrame, n_docs: int, k: int = MAX_FEATURES) -> tuple[list[str], list[float]]:
    """``fitted_idf`` of document frequencies."""
    rows = vocabulary(dfreq, k).select("term", "df", "rank").collect()
    rows.sort(key=lambda r: r["rank"])
    return [r["term"] for r in rows], [math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in rows]


def tfidf(counts: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(key, term, tfidf) of counted documents, L2-normalised per
    document over the in-vocabulary terms; out-of-vocabulary terms are ignored
    and a document without known terms has no rows."""
    vectors = counts.selectExpr(f"`{key}`", f"{vocabulary.vector('counts', 'idf')} AS _v")
    normed = vectors.selectExpr(f"`{key}`", "_v", f"{norm('_v')} AS _norm")
    entries = f"transform(_v, h -> named_struct('term', {vocabulary.term('h.i')}, 'tfidf', h.x / _norm))"
    return normed.selectExpr(f"`{key}`", f"inline_outer({entries})").where(F.col("term").isNotNull())


# --- counts of the terms that can be in a vocabulary -----------------------------

# A vocabulary is the few most frequent of very many terms.  Occurrences are
# counted by hash bucket first; a term occurs at most as often as its bucket,
# so that terms of rare buckets are left out of the counts by term, and the
# most frequent ones have exact counts.  Size and result of the first pass do
# not depend on the number of terms.
TERM_BUCKETS = 1 << 21
# Buckets whose counts are added up together: a task sends blocks of counts.
BLOCK = 1 << 15
# Buckets taken at first, for each term of the vocabulary.
SPARE = 4
# Bytes of text handled at a time inside a task.
CHUNK = 8 << 20


def bucket_of(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Bucket of a token, or of two adjacent ones, by their hashes."""
    x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if second is not None:
        x = (x ^ (x >> np.uint64(29))) + (second.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - TERM_BUCKETS.bit_length() + 1)).astype(np.int64)


def hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def packed(buckets: np.ndarray) -> bytes:
    mask = np.zeros(TERM_BUCKETS, bool)
    mask[buckets] = True
    return zlib.compress(np.packbits(mask).tobytes(), 1)


def unpacked(mask: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(mask), np.uint8)).astype(bool)


def buckets_of_terms(terms: Sequence[str]) -> bytes:
    """The buckets of given terms."""
    parts = [t.split(" ") for t in terms]
    first, second = (hashes(pa.array([p[i] for p in parts if len(p) == 2], pa.string())) for i in (0, 1))
    single = hashes(pa.array([p[0] for p in parts if len(p) == 1], pa.string()))
    return packed(np.concatenate([bucket_of(single), bucket_of(first, second)]))


def spaced_tokens(text: str) -> Column:
    """The runs of word characters, lower-cased, joined by one space: the tokens
    and, which are none, single characters."""
    other = TOKEN_PATTERN.replace("[", "[^").replace("{2,}", "+")
    return F.coalesce(F.regexp_replace(F.lower(F.col(text)), F.lit(other), F.lit(" ")), F.lit(""))


def token_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """Whole rows of ``spaced_tokens``, at most ``CHUNK`` bytes together if each
    has fewer: (number of rows, row of each token, distinct tokens, place of
    each token among them)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    start, n = 0, len(texts)
    while start < n:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        runs = pc.split_pattern(texts.slice(start, end - start), " ")
        words, rows = pc.list_flatten(runs), pc.list_parent_indices(runs).to_numpy()
        held = pc.greater_equal(pc.utf8_length(words), 2)
        coded = words.filter(held).dictionary_encode()
        yield (end - start, rows[held.to_numpy(zero_copy_only=False)].astype(np.int64), coded.dictionary,
               coded.indices.to_numpy().astype(np.int64))
        start = end


def bucket_counts(df: DataFrame, text: str = "text", max_n: int = NGRAM_MAX) -> DataFrame:
    """(bucket, n): occurrences of all terms by bucket."""
    def count(batches):
        total = np.zeros(TERM_BUCKETS, np.int64)
        for batch in batches:
            for _, rows, words, codes in token_chunks(batch.column(0)):
                hashed = hashes(words)
                total += np.bincount(bucket_of(hashed)[codes], minlength=TERM_BUCKETS)
                if max_n == 2:
                    pair = np.flatnonzero(rows[1:] == rows[:-1])
                    total += np.bincount(bucket_of(hashed[codes[pair]], hashed[codes[pair + 1]]), minlength=TERM_BUCKETS)
        for block, part in enumerate(total.reshape(-1, BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()])], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in table["counts"])
        used = np.flatnonzero(total)
        return pa.table({"bucket": pa.array(used + table["block"][0].as_py() * BLOCK), "n": pa.array(total[used])})

    parts = df.select(spaced_tokens(text).alias("runs")).mapInArrow(count, "block long, counts binary")
    return parts.groupBy("block").applyInArrow(add, "bucket long, n long")


def counted_rows(texts: pa.Array, among: np.ndarray, max_n: int) -> pa.ListArray:
    """Terms of marked buckets with their counts, by row, ordered by term."""
    parts = []
    for n_rows, rows, words, codes in token_chunks(texts):
        hashed, base = hashes(words), len(words) + 1
        held = np.flatnonzero(among[bucket_of(hashed)][codes])
        keys, owners = [codes[held] * base], [rows[held]]
        if max_n == 2:
            pair = np.flatnonzero(rows[1:] == rows[:-1])
            pair = pair[among[bucket_of(hashed[codes[pair]], hashed[codes[pair + 1]])]]
            keys.append(codes[pair] * base + codes[pair + 1] + 1)
            owners.append(rows[pair])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        first, second = distinct // base, distinct % base - 1
        first = words.take(pa.array(first))
        joined = pc.binary_join_element_wise(first, words.take(pa.array(second, mask=second < 0)), " ")
        terms = pc.coalesce(joined, first).cast(pa.string())
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        size = max(len(order), 1)
        found, tf = np.unique(np.concatenate(owners) * size + rank[place], return_counts=True)
        ends = np.cumsum(np.bincount(found // size, minlength=n_rows))
        entries = pa.StructArray.from_arrays([terms.take(pa.array(order[found % size])), pa.array(tf.astype(np.int32))], ["term", "tf"])
        parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), entries))
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def counted_among(df: DataFrame, among: bytes, text: str = "text", max_n: int = NGRAM_MAX, out: str = "counts") -> DataFrame:
    """``df`` with ``out``: the counts of ``counted`` for the terms of the marked
    buckets, which may be a few more than those asked for."""
    @F.arrow_udf("array<struct<term: string, tf: int>>")
    def count(rows: pa.Array) -> pa.Array:
        return counted_rows(rows, unpacked(among), max_n)

    return df.withColumn("_runs", spaced_tokens(text)).withColumn(out, count("_runs")).drop("_runs")


def frequent_counts(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = MAX_FEATURES,
                    max_n: int = NGRAM_MAX, fit_on: str = "true") -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``df`` with ``counts`` instead of the text, which
    hold at least the ``k`` most frequent terms of the rows of ``fit_on``, ties
    included; and the ``doc_freq`` of those rows' counts.

    The most frequent buckets are taken first.  A term outside of them occurs
    less often than the rarest of them; if the ``k``-th term found does too,
    all buckets of its frequency are taken, which hold every term as frequent.
    """
    buckets = stored(bucket_counts(df.where(fit_on), text, max_n), "buckets")
    least = buckets.orderBy(F.desc("n")).limit(max(int(SPARE * k), 1)).agg(F.coalesce(F.min("n"), F.lit(1))).first()[0]

    def tables(least: int) -> tuple[DataFrame, DataFrame]:
        hot = buckets.where(F.col("n") >= least).select("bucket").toArrow()["bucket"].to_numpy()
        counts = stored(counted_among(df, packed(hot), text, max_n).drop(text), "counts")
        return counts, stored(doc_freq(long_form(counts.where(fit_on), key), key), "frequencies")

    counts, dfreq = tables(least)
    n, cf = vocabulary(dfreq, k).agg(F.count(F.lit(1)), F.min("cf")).first()
    reached = cf if n == k else 1
    return (counts, dfreq) if reached >= least else tables(reached)
