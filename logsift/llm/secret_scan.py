"""Secret scans with corpus-wide ownership frequency (operator 8).

Three patterns give the base spans; a fourth finds long mixed tokens that look
random.  Every candidate's value is hashed, and the distinct repositories and
owners that hold it are counted over the whole corpus: a value that many
owners share, or that lies in many repositories of few owners, is a copied
example; one that stays in few places looks live.  Base spans always stay,
with the verdict beside them; a mixed token becomes a span of the kind
``live`` only when it is not copied.  Both counts stand beside every span.

Values are only kept as hashes.

Defined cases: a null text counts as empty; a null owner or repository counts
as one owner or repository of its own; repositories of one name under two
owners are two; repeated rows change no count of distinct owners; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import saved

# The base kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE).finditer
_access = re.compile("AKIA[A-Z0-9]+").finditer
_hex = re.compile(f"[0-9a-f]{{{LEAST_HEX},}}").finditer
_mixed = re.compile("[A-Za-z0-9+/_=-]{20,}").finditer


@dataclass(frozen=True)
class Ownership:
    """``copied_owners``, ``copied_repos``: a value held by so many owners, or
    in so many repositories, is an example; ``min_entropy``: bits per
    character of a mixed token."""

    copied_owners: int = 3
    copied_repos: int = 6
    min_entropy: float = 3.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str | None, min_entropy: float) -> list[tuple[int, int, int, str]]:
    """``(start, kind number, end, value)`` by start, then kind."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _assign(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _access(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in _hex(text)]
    base = sorted((a, b) for a, _, b, _ in found)
    for m in _mixed(text):
        value = m[0]
        if not (any(c.isdigit() for c in value) and any(c.isupper() for c in value)
                and any(c.islower() for c in value)):
            continue
        if any(a < m.end() and m.start() < b for a, b in base) or entropy(value) < min_entropy:
            continue
        found.append((m.start(), 3, m.end(), value))
    return sorted(found)


def span_text(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<a:int,k:int,b:int,v:string>>"


def scanner(rule: Ownership):
    least = rule.min_entropy

    @F.pandas_udf(SCANNED)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = candidates(text, least)
            base = [s for s in spans if s[1] < 3]
            kinds = Counter(s[1] for s in base)
            rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(span_text(base).encode()).hexdigest(),
                         [{"a": a, "k": k, "b": b, "v": hashlib.sha256(v.encode()).hexdigest()} for a, k, b, v in spans]))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return scan


def ownership(found: DataFrame) -> DataFrame:
    """``v, n_owners, n_repos``: distinct owners and repositories of a value,
    by steps that each combine before they shuffle, so that a value found in
    a third of the corpus is one row per task."""
    pairs = found.groupBy("v", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("v", "owner").agg(F.count("*").alias("n_repos"))
    return owners.groupBy("v").agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"))


def scan_secrets(docs: DataFrame, owner: Column, repo: Column, rule: Ownership = Ownership(),
                 text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_copied, span_owners, span_repos`` of every document; ``n_live`` and
    ``n_copied`` count its base spans by ownership, the last two list the
    owners and repositories of each span's value in the order of ``spans``."""
    scan = scanner(rule)
    rows = docs.select("doc_id", owner.alias("owner"), repo.alias("repo"),
                       scan(F.col(f"`{text}`").cast("string")).alias("s"))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", "s.*"), "scanned")
    found = (rows.filter(F.size("found") > 0)
             .select("rid", "owner", "repo", F.explode("found").alias("f")).select("rid", "owner", "repo", "f.*"))
    copied = (F.col("n_owners") >= rule.copied_owners) | (F.col("n_repos") >= rule.copied_repos)
    judged = found.select("rid", "a", "k", "b", "v").join(ownership(found), "v").withColumn("copied", copied)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1)
    spans = (judged.filter("k < 3 OR NOT copied")
             .select("rid", "k", "copied", F.struct("a", "k", "b", F.concat_ws(":", kind, "a", "b").alias("t"),
                                                    F.col("n_owners").cast("string").alias("owners"),
                                                    F.col("n_repos").cast("string").alias("repos")).alias("s"))
             .groupBy("rid").agg(F.array_sort(F.collect_list("s")).alias("spans"),
                                 F.count_if((F.col("k") < 3) & ~F.col("copied")).alias("n_live"),
                                 F.count_if((F.col("k") < 3) & F.col("copied")).alias("n_copied")))
    zero = F.lit(0).cast("long")

    def listed(field: str) -> Column:
        return F.coalesce(F.array_join(F.col(f"spans.{field}"), ","), F.lit(""))

    return rows.join(spans, "rid", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        listed("t").alias("spans"), F.coalesce("n_live", zero).alias("n_live"),
        F.coalesce("n_copied", zero).alias("n_copied"), listed("owners").alias("span_owners"),
        listed("repos").alias("span_repos"))
