"""URL filters by association rules (operator 10).

Urls become sets of tokens: the host's labels, the parts of the path and the
names of the query's parameters.  Spark's FP-growth mines the token sets of
labelled urls together with a marker for a blocked label; the sets that lead
to the marker with enough support and confidence are the rules, of which only
those remain that no smaller rule makes superfluous.  Rules match through an
inverted index: the rules' tokens are joined to the urls' tokens, and a rule
fires where all its tokens were found.  A fixed list of host and path rules
goes before; the longest that fits a url decides.

Bounds: FP-growth keeps tokens above ``min_support`` (and ``min_pages``, if
asked for), at most (tokens per url) / ``min_support`` of them.  Tokens that
occur in the same urls only are one item, tokens that are rules by themselves
or are in too few blocked urls for any rule are none, so that urls of many
tokens multiply no itemsets; a rule holds no smaller rule, and may have any
number of items.

Defined cases: a null url, or one without ``://``, has an empty host and path;
it meets no fixed rule; without labels or rules every other url is allowed;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import join_unique, saved

# Fixed values: (host, path, verdict).
FIXED_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
               ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MARK = "\u0000block"


@dataclass(frozen=True)
class Mining:
    """A rule needs ``min_support`` of the labelled urls and ``min_pages`` of
    them, blocked, and ``min_confidence``.  The query asks for every supported
    rule (``min_pages`` 1)."""

    min_support: float = 0.005
    min_confidence: float = 0.8
    min_pages: int = 5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens ``h:label``, ``p:part``, ``q:name``."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(
        marked("h:", F.split(host_of(url), "\\.")), marked("p:", F.split(path_of(url), "/")),
        marked("q:", names)))


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest fixed rule that fits."""
    rules = sorted(FIXED_RULES, key=lambda r: -len(r[0] + r[1]))
    name = verdict = None
    for h, p, v in rules:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        n = F.lit(h + p)
        name = F.when(fits, n) if name is None else name.when(fits, n)
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return name, verdict


def token_names(labelled: DataFrame, least: int) -> DataFrame:
    """``token, name, n, n_blocked`` of the tokens in ``least`` labelled urls or
    more, from ``id, tokens, blocked``.  Tokens found in exactly the same urls share the name of
    the first: as items they are one, else every subset of them would be mined."""
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(38,0)"))
    seen = (labelled.select("id", F.explode("tokens").alias("token"), "blocked").groupBy("token")
            .agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"), mark(1).alias("x"), mark(2).alias("y"))
            .filter(F.col("n") >= least))
    seen = saved(seen, "tokens")
    names = seen.groupBy("n", "x", "y").agg(F.min("token").alias("name"))
    return saved(seen.join(names, ["n", "x", "y"]).select("token", "name", "n", "n_blocked"), "names")


def named(rows: DataFrame, names: DataFrame, key: str, where: str = "true") -> DataFrame:
    """``key, name``: the distinct names of the rows' tokens, of those that
    ``where`` lets through."""
    each = rows.select(key, F.explode("tokens").alias("token"))
    return join_unique(each, names, "token").filter(f"name IS NOT NULL AND {where}").select(key, "name").distinct()


def mine_rules(labelled: DataFrame, mining: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """From ``tokens, blocked`` rows: ``rule_id, tokens (names), n``; and the
    names."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("blocked") | (F.size("tokens") > 0))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("id"), "tokens", "blocked"), "labelled")
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, n int")
    n_rows = rows.count()
    least = max(math.ceil(mining.min_support * n_rows), mining.min_pages)
    names = token_names(rows, least)
    if not n_rows or names.isEmpty():
        return empty, names
    # A name that is a rule covers all sets that hold it, and one in too few
    # blocked urls is in no rule: neither is an item.
    alone = f"n_blocked / n >= {mining.min_confidence!r}D"
    single = saved(names.filter(f"n_blocked >= {least} AND {alone} AND token = name").select(F.array("name").alias("tokens")), "single")
    marks = rows.filter("blocked").select("id", F.lit(MARK).alias("name"))
    mixed = named(rows, names, "id", f"n_blocked >= {least} AND NOT {alone}")
    items = saved(mixed.union(marks).groupBy("id").agg(F.collect_set("name").alias("items")), "transactions")
    n_items = items.count()
    if not n_items:
        return empty, names
    # Half a row below the count, so that rounding does not ask for one more.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n_items)).fit(items)
    sets = saved(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    whole = sets.filter(~F.array_contains("items", MARK)).select(F.col("items").alias("tokens"), F.col("freq").alias("n"))
    blocked = (sets.filter(F.array_contains("items", MARK) & (F.size("items") > 1))
               .select(F.array_remove("items", MARK).alias("tokens"), F.col("freq").alias("n_blocked")))
    strong = blocked.join(whole, "tokens").filter(F.col("n_blocked") / F.col("n") >= mining.min_confidence)
    strong = strong.select("tokens").union(single)
    strong = saved(strong.select(F.xxhash64("tokens").alias("rule_id"), "tokens", F.size("tokens").alias("n")), "strong")
    # From the smallest on: a set on which a smaller rule fires is no rule.
    sizes = sorted(r.n for r in strong.select("n").distinct().collect())
    rules = empty
    for k, size in enumerate(sizes):
        more = strong.filter(F.col("n") == size)
        if k:
            covered = fired(more.select(F.col("tokens").alias("key"), "tokens"), rules, names)
            more = more.join(covered, more["tokens"] == covered["key"], "left_anti")
        rules = saved(rules.union(more) if k else more, "rules")
    return rules, names


def fired(rows: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """Keys of rows on which a rule fires, from ``key, tokens`` rows: all its
    names are found; counts are combined before they are shuffled."""
    index = rules.select("rule_id", F.col("n").alias("rule_n"), F.explode("tokens").alias("name"))
    found = named(rows, names, "key").join(index, "name")
    return (found.groupBy("key", "rule_id").agg(F.count("*").alias("hits"), F.first("rule_n").alias("rule_n"))
            .filter("hits = rule_n").select("key").distinct())


def judge_urls(pages: DataFrame, labels: DataFrame, mining: Mining = Mining(),
               key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``labels``: ``key`` and ``blocked``; a page that has labels of both kinds
    counts once with each.  The url itself is the key of the index, so that
    equal urls are looked up once.
    """
    urls = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    marked = labels.select(F.col(f"`{key}`").alias("page_id"), "blocked").filter("blocked IS NOT NULL")
    training = urls.join(marked, "page_id").select(tokens_of(F.col("url")).alias("tokens"), "blocked")
    rules, names = mine_rules(training, mining)
    distinct = urls.filter("url IS NOT NULL").select(F.col("url").alias("key")).distinct()
    bad = saved(fired(distinct.select("key", tokens_of(F.col("key")).alias("tokens")), rules, names), "fired")
    rows = urls.join(bad.withColumn("hit", F.lit(True)), urls["url"] == bad["key"], "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "hit")
    name, verdict = fixed_rule(F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", name.alias("rule"),
                       F.coalesce(verdict, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
