"""Quality rules with host verdicts (operator 1).

Row rules count words, symbols, repeated lines and repeated five-word windows
of a whole text.  Rule failures are then aggregated by host; every host's
failure rate is shrunk with a beta prior whose parameters are the moments of
the observed host rates, and the verdict of a bad host is joined back to its
documents.

Defined cases: a null or empty text has no words and fails the base rule; a
null host has no verdict (only the base rule decides); an empty table gives an
empty result; repeated rows count as often as they occur.  Only the named
columns are read, other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import WORD, saved

_WORDS = re.compile(WORD).findall
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]").search
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class HostRules:
    """``symbol_share``: a text also fails when symbols make up more than this
    percentage of its word characters; ``max_host_rate``: hosts whose shrunk
    failure rate is above are rejected; ``default_strength``: weight of the
    prior, in documents, when the hosts' rates do not vary."""

    symbol_share: int = 20
    max_host_rate: float = 0.5
    default_strength: float = 10.0


def repeated_words(words: list[str]) -> int:
    """Words inside five-word windows that occur at least twice."""
    n = len(words) - 4
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORDS(text)
    lines = [x for x in text.split("\n") if _HAS_WORD(x)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def rule_counts(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in text], columns=COUNTS, dtype="int64")


def base_failed(m: str = "m") -> Column:
    words, repeated = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (words < 10) | (100 * repeated > 20 * words)


def rule_failed(rules: HostRules, m: str = "m") -> Column:
    return base_failed(m) | (100 * F.col(f"{m}.n_symbols") > rules.symbol_share * F.col(f"{m}.word_chars"))


def host_table(measured: DataFrame) -> DataFrame:
    """``host, n, n_failed`` from rows of ``host, failed``; partial sums keep a
    host that holds a third of the rows from meeting in one task."""
    return (measured.filter("host IS NOT NULL").groupBy("host")
            .agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed")))


def beta_prior(hosts: DataFrame, rules: HostRules) -> tuple[float, float]:
    """Beta parameters by the moments of the host rates (one row)."""
    rate = F.col("n_failed") / F.col("n")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if mean is None:
        return 1.0, 1.0
    strength = rules.default_strength
    if var and var < mean * (1 - mean):
        strength = mean * (1 - mean) / var - 1
    return mean * strength, (1 - mean) * strength


def rejected_hosts(measured: DataFrame, rules: HostRules) -> DataFrame:
    """Hosts whose shrunk failure rate is above the limit, as a written table:
    its size is then known when the join is planned (broadcast only below the
    session's threshold, shuffle join with skew splitting beyond)."""
    hosts = saved(host_table(measured), "hosts")
    a, b = beta_prior(hosts, rules)
    shrunk = (F.col("n_failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return saved(hosts.filter(shrunk > rules.max_host_rate)
                 .select("host", shrunk.alias("host_rate")), "rejected")


def judge(docs: DataFrame, rules: HostRules = HostRules(), keys: tuple[str, ...] = ("doc_id",),
          text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: ``keys``, the counts, ``base_failed``,
    ``host_rejected`` and ``kept``.  The texts are read once; the counts are a
    small written table that the host verdicts are joined to."""
    m = docs.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k"),
                    F.col(f"`{host}`").alias("host"),
                    rule_counts(F.col(f"`{text}`").cast("string")).alias("m"))
    m = saved(m.select("k", "host", "m", base_failed().alias("base_failed"),
                       rule_failed(rules).alias("failed")), "counts")
    bad = rejected_hosts(m, rules)
    out = m.join(bad, "host", "left")
    rejected = F.col("host_rate").isNotNull()
    return out.select("k.*", "m.*", "base_failed", rejected.alias("host_rejected"),
                      (~F.col("base_failed") & ~rejected).alias("kept"))


def keep_good(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text",
              host: str = "source") -> DataFrame:
    """``docs`` without the documents that ``judge`` rejects.  Two passes over
    the texts (failures by host, then the decision), no shuffle of texts when
    the rejected hosts are few."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                    F.col(f"`{host}`").alias("host"),
                    rule_counts(F.col(f"`{text}`").cast("string")).alias("m"))
    bad = rejected_hosts(d.select("host", rule_failed(rules).alias("failed")), rules)
    return d.filter(~base_failed()).join(bad, "host", "left_anti").select("doc.*")
