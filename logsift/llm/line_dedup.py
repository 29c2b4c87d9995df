"""Line dedup by distinct-site spread (operator 3), with DataFrame functions.

Every line of a document is hashed, and a HyperLogLog sketch of the sites it
occurs on is kept per line; sketches merge as the aggregation does.  Lines
whose estimate is clearly above the threshold are boilerplate, those clearly
below are not, and the lines near the threshold get exact distinct counts.
Boilerplate lines are then removed from every document.

The sketch's standard error at ``lg_k`` = 12 is 1.6 %; the band around the
threshold is many times that, so that no line is decided by its sketch alone
where the sketch could be wrong.

Lines of fewer than ``min_words`` words may be prose that many sites share by
chance, so they need ``short_sites`` sites instead of ``min_sites``.  Lines
without a word stay.

Removal is linear in a document's lines: the places of its boilerplate lines
come back as one list.  Lines with more than a thousandth of all boilerplate
occurrences are joined by broadcast, so no task gets all rows of a frequent
line.

Defined cases: a null text counts as empty and has no lines; a null site is a
site of its own; repeated rows add no site; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import WORD, join_unique, keyed_rows, saved, text_of


@dataclass(frozen=True)
class Spread:
    """``min_sites``: sites that make a line of ``min_words`` words
    boilerplate, ``short_sites`` a shorter one; ``band``: relative width of the
    zone of exact counts; ``lg_k``: log of the sketch size."""

    min_sites: int = 8
    min_words: int = 5
    short_sites: int = 16
    band: float = 0.25
    lg_k: int = 12


def line_key(line: Column) -> Column:
    """128-bit hash of a line."""
    return F.struct(F.xxhash64(F.lit(1), line).alias("a"), F.xxhash64(F.lit(2), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_rows(rows: DataFrame, text: str, site: str, rule: Spread) -> DataFrame:
    """``row key, site, pos, need, a, b``: one row for each line with a word;
    ``need``: the sites that make it boilerplate."""
    words = lambda x: F.regexp_count(x, F.lit(WORD))
    need = lambda x: F.when(words(x) >= rule.min_words, F.lit(rule.min_sites)).otherwise(F.lit(rule.short_sites))
    entries = F.transform(_lines(text_of(F.col(f"doc.`{text}`"))), lambda x, i: F.when(
        F.regexp_like(x, F.lit(WORD)), F.struct(i.alias("pos"), need(x).alias("need"), line_key(x).alias("k"))))
    name = F.col(f"doc.`{site}`").cast("string")
    # Sketches leave out empty texts.
    site_key = F.when(name.isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), name))
    return (rows.select("row_file", "row_no", site_key.alias("site"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
            .select("row_file", "row_no", "site", "e.pos", "e.need", "e.k.a", "e.k.b"))


def boilerplate(lines: DataFrame, rule: Spread) -> DataFrame:
    """``(a, b, n)`` of the lines found on as many sites as they need, with
    the number of their occurrences."""
    seen = (lines.groupBy("a", "b")
            .agg(F.count("*").alias("n"), F.max("need").alias("need"), F.hll_sketch_agg("site", rule.lg_k).alias("sketch"))
            .filter(F.col("n") >= F.col("need"))
            .select("a", "b", "n", "need", F.hll_sketch_estimate("sketch").alias("sites")))
    seen = saved(seen.filter(F.col("sites") >= F.col("need") * (1 - rule.band)), "spread")
    sure = F.col("sites") > F.col("need") * (1 + rule.band)
    near = seen.filter(~sure).select("a", "b", "n", "need")
    exact = (lines.join(near.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "site").distinct()
             .groupBy("a", "b").agg(F.count("*").alias("exact")))
    enough = near.join(exact, ["a", "b"]).filter(F.col("exact") >= F.col("need"))
    return saved(seen.filter(sure).select("a", "b", "n").union(enough.select("a", "b", "n")), "boilerplate")


def remove_boilerplate(docs: DataFrame, rule: Spread = Spread(), text: str = "text", site: str = "source") -> DataFrame:
    """``doc`` (all columns of the input), ``n_lines, n_removed, clean``: the
    text without its boilerplate lines."""
    rows = keyed_rows(docs)
    lines = _line_rows(rows, text, site, rule)
    bad = boilerplate(lines, rule)
    # One key column, checked on both halves of the hash.
    known = bad.select(F.struct("a", "b").alias("k"), "n")
    found = join_unique(lines.select("row_file", "row_no", "pos", F.struct("a", "b").alias("k")), known, "k")
    hits = found.filter("n IS NOT NULL").groupBy("row_file", "row_no").agg(F.collect_list("pos").alias("hits"))
    hits = saved(hits, "hits").hint("shuffle_hash")
    out = rows.join(hits, ["row_file", "row_no"], "left")
    out = out.select("doc", "hits", _lines(text_of(F.col(f"doc.`{text}`"))).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "hits")
    kept = F.when(F.col("hits").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    out = out.select("doc", "lines", kept.alias("kept"))
    return out.select("doc", F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
                      F.array_join("kept", "\n").alias("clean"))
