"""Language ID by Bayesian evidence fusion (operator 5).

Four kinds of evidence meet in one posterior: the likelihood of the text's
byte trigrams under each language, the language declared in the markup, the
address suffix, and the host.  Suffix and host enter as priors that grouped
aggregation counts over the corpus and shrinks along the hierarchy all ->
suffix -> host, so a host with few documents takes its suffix's prior.  A
record's own text is left out of every sum that its prior is made of, so no
record is evidence for itself.  A host without a dot has no suffix and hangs
below all records.

The trigram model is trained on labelled texts, all of them.

Bounds: at most ``MAX_LANGUAGES`` labels (else an error); the trigram table
(``TRIGRAMS`` bins for each) and the table of declared languages are the only
things that reach the driver.

Defined cases: a text without trigrams gives no evidence, the priors decide;
a null or unknown declaration gives none; a null host takes the prior of all;
repeated rows are records of their own; an empty table gives an empty result;
without any label there is no language: both are null, with confidence 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import saved

TRIGRAMS = 1 << 15
MAX_LANGUAGES = 200


@dataclass(frozen=True)
class Fusion:
    """``trigrams``: evidence of a text counts as that of so many independent
    trigrams at most; ``strength``: weight of a prior's parent, in documents;
    ``min_confidence``: posterior from which a record is kept."""

    trigrams: int = 150
    strength: float = 20.0
    min_confidence: float = 0.5


def trigram_bins(text: str | None) -> np.ndarray:
    """Bins of all byte trigrams of a text, lower-cased."""
    a = np.frombuffer((text or "").lower().encode(), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.uint32)
    x = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(17)) & np.uint32(TRIGRAMS - 1)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in counts and len(counts) >= MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
            mine = counts.setdefault(lang, np.zeros(TRIGRAMS, np.int64))
            mine += np.bincount(trigram_bins(text.as_py()), minlength=TRIGRAMS)
    for lang, mine in counts.items():
        used = np.flatnonzero(mine)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()),
                                          "bin": pa.array(used, pa.int32()), "n": pa.array(mine[used], pa.int64())})


class TextModel:
    """Log probabilities of trigrams by language, smoothed by one half."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        c = np.array([counts[x] for x in self.languages], float).reshape(-1, TRIGRAMS) + 0.5
        self.logs = np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)

    def evidence(self, text: str | None, most: int) -> np.ndarray:
        """Log likelihoods, scaled to at most ``most`` trigrams."""
        bins = trigram_bins(text)
        if not len(bins):
            return np.zeros(len(self.languages))
        total = np.zeros(len(self.languages))
        for i in range(0, len(bins), 1 << 20):
            total += self.logs[:, bins[i:i + (1 << 20)]].sum(axis=1, dtype=np.float64)
        return total * (min(most, len(bins)) / len(bins))


def fit(labelled: DataFrame) -> TextModel:
    """Train on ``lang, text`` rows; null labels are left out."""
    rows = labelled.filter("lang IS NOT NULL").select("lang", "text").mapInArrow(_count_trigrams, "lang string, bin int, n long")
    total = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in total.limit(MAX_LANGUAGES * TRIGRAMS + 1).collect():
        if r["lang"] not in counts and len(counts) >= MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        counts.setdefault(r["lang"], np.zeros(TRIGRAMS, np.int64))[r["bin"]] = r["n"]
    return TextModel(counts)


def visible_text(html: Column) -> Column:
    """Text of a page without tags, scripts, styles, comments, entities."""
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")


def declared_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1)), F.lit(""))


def _with_softmax(rows: DataFrame, logs: str, out: str) -> DataFrame:
    """``rows`` with the probabilities ``out`` of the column ``logs``; each
    step is a column, as a lambda would repeat it for every element."""
    rows = rows.withColumn("_most", F.array_max(logs))
    rows = rows.withColumn("_exp", F.transform(logs, lambda x: F.exp(x - F.col("_most"))))
    rows = rows.withColumn("_sum", F.aggregate("_exp", F.lit(0.0), lambda s, v: s + v))
    return rows.withColumn(out, F.transform("_exp", lambda x: x / F.col("_sum"))).drop("_most", "_exp", "_sum")


def _best(languages: list[str], values: Column) -> Column:
    at = F.array_position(values, F.array_max(values)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in languages]), at)


def declaration_logs(rows: DataFrame, languages: list[str]) -> dict[str, list[float]]:
    """Log of P(declared | language) over the known languages, counted from
    the languages that the texts point to."""
    known = rows.filter(F.col("declared").isin(languages))
    counts = known.groupBy("declared", "text_lang").count().limit(MAX_LANGUAGES ** 2 + 1).collect()
    table = {(r["declared"], r["text_lang"]): r["count"] for r in counts}
    n = len(languages)
    of = {x: sum(table.get((d, x), 0) for d in languages) for x in languages}
    return {d: [float(np.log((table.get((d, x), 0) + 1) / (of[x] + n))) for x in languages] for d in languages}


def host_sums(rows: DataFrame, languages: list[str]) -> tuple[DataFrame, list[float], int]:
    """``host, n, s, suffix_n, suffix_s``: records and summed probabilities of
    a host and of its suffix (null for hosts without one); and those of all."""
    places = range(len(languages))
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col("p")[i]).alias(f"s{i}") for i in places])
    suffix = F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -1))
    hosts = saved(hosts.select("host", suffix.alias("suffix"), "n", F.array(*[f"s{i}" for i in places]).alias("s")), "hosts")
    add = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in places]
    whole = hosts.agg(F.sum("n").alias("n"), *add).first()
    known = hosts.filter("host IS NOT NULL")
    suffixes = known.filter("suffix IS NOT NULL").groupBy("suffix").agg(F.sum("n").alias("suffix_n"), *add)
    suffixes = suffixes.select("suffix", "suffix_n", F.array(*[f"s{i}" for i in places]).alias("suffix_s"))
    sums = known.join(suffixes, "suffix", "left").select("host", "n", "s", "suffix_n", "suffix_s")
    return saved(sums, "sums"), [x or 0.0 for x in whole[1:]], whole["n"] or 0


def _with_prior(rows: DataFrame, overall: list[float], n_all: int, strength: float) -> DataFrame:
    """``rows`` with ``prior``: all -> suffix -> host, each level without the
    record itself and with its parent as so many records."""
    def level(sums: str, n: str, parent: str) -> Column:
        own = F.zip_with(sums, "p", lambda s, p: s - p)
        return F.coalesce(F.zip_with(own, parent, lambda s, q: (s + strength * q) / (F.col(n) - 1 + strength)), F.col(parent))

    everything = F.array(*[F.lit(x) for x in overall])
    top = F.zip_with(everything, "p", lambda s, p: (s - p + 1) / F.lit(float(n_all - 1 + len(overall))))
    rows = rows.withColumn("_top", top)
    rows = rows.withColumn("_parent", level("suffix_s", "suffix_n", "_top"))
    return rows.withColumn("prior", level("s", "n", "_parent")).drop("_top", "_parent")


def identify(records: DataFrame, model: TextModel, fusion: Fusion = Fusion()) -> DataFrame:
    """``key.*, text_lang, lang, confidence, kept`` for records of ``key
    (struct), text, declared, host``."""
    languages, most = model.languages, fusion.trigrams
    if not languages:
        none = F.lit(None).cast("string")
        return records.select("key.*", none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("confidence"),
                              F.lit(False).alias("kept"))
    shared = records.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.evidence(t, most) for t in texts], dtype=object)

    rows = records.select("key", "declared", "host", evidence("text").alias("e"))
    rows = _with_softmax(rows, "e", "p").withColumn("text_lang", _best(languages, F.col("e")))
    rows = saved(rows, "evidence")
    logs = declaration_logs(rows, languages)
    sums, overall, n_all = host_sums(rows, languages)
    declared = F.array(*[F.lit(0.0)] * len(languages))
    for d, values in logs.items():
        declared = F.when(F.col("declared") == d, F.array(*[F.lit(v) for v in values])).otherwise(declared)
    rows = rows.join(sums, "host", "left").withColumn("d", declared)
    rows = _with_prior(rows, overall, n_all, fusion.strength)
    rows = rows.withColumn("f", F.zip_with(F.zip_with("e", "d", lambda a, b: a + b), "prior", lambda a, b: a + F.log(b)))
    confidence = F.round(F.array_max("q"), 4)
    return _with_softmax(rows, "f", "q").select(
        "key.*", "text_lang", _best(languages, F.col("f")).alias("lang"), confidence.alias("confidence"),
        (confidence >= fusion.min_confidence).alias("kept"))
