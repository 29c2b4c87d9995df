"""Mixing sources to target weights by Pareto order sampling (operator 7).

Every source gets a word target.  A document's expected number of copies is
its source's target over the source's words; the whole part is allocated with
certainty, the rest is its inclusion probability p.  Documents are ranked by
the Pareto key ``(u / (1 - u)) / (p / (1 - p))`` with u fixed by the
document's id and text, and the front of that order is taken until the words still due
are reached: a sample whose size in words is fixed.

The cut of a source is found from sums over fixed bins of the key and one
exact pass inside the bin that holds it, so that no source is sorted as a
whole; the decision is then a comparison of each row with its source's cut.

Bounds: up to ``DRIVER_SOURCES`` sources are planned on the driver and their
table is broadcast.  With more the table stays in Spark: ranks and sums in
order come from range partitions, of which the driver sees one row each and
the common level, and the joins by source are left to the planner.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0; rows that share id and
text are decided alike, rows that share only one of them are not; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import WORD, saved, text_of

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
DRIVER_SOURCES = 10_000
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """u in (0, 1), fixed by id and text, so that rows without an id, or with
    the same one, have draws of their own: the first 48 bits of an md5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def fill(sizes: Sequence[int], weights: Sequence[int], max_copies: int = MAX_COPIES) -> list[float]:
    """Shares of all words by weight, none above ``max_copies`` times its
    source: the sources that stop first are those with the smallest limit per
    weight, so one pass in that order finds the common level of the rest."""
    total, weight, out = float(sum(sizes)), sum(weights), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (max_copies * sizes[i] / weights[i], i)):
        out[i] = min(float(max_copies * sizes[i]), total * weights[i] / weight)
        total, weight = total - out[i], weight - weights[i]
    return out


def source_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS) -> tuple[DataFrame, bool]:
    """``source, source_size, target, copies, p, due``: one row per source;
    and whether that table is small enough for a broadcast."""
    totals = saved(rows.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    few = totals.limit(DRIVER_SOURCES + 1).collect()
    if len(few) > DRIVER_SOURCES:
        return _plan_in_spark(totals, weights), False
    few.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in few]
    targets = fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    plan = []
    for r, t in zip(few, targets):
        ratio = t / r["size"] if r["size"] else 0.0
        copies = min(int(ratio), MAX_COPIES)
        p = ratio - copies if copies < MAX_COPIES else 0.0
        plan.append((r.source, r["size"], t, copies, p, t - copies * r["size"]))
    return rows.sparkSession.createDataFrame(
        plan, "source string, source_size long, target double, copies long, p double, due double"), True


def with_sums_before(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over all rows that come
    before in ``order``: within range partitions, after the totals of the
    partitions before, which are one row each."""
    parts = saved(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    start, starts = [0] * len(sums), []
    each = parts.groupBy("part").agg(*[F.sum(c).cast("long").alias(name) for name, c in sums.items()])
    for r in sorted(each.collect(), key=lambda r: r.part):
        starts.append((r.part, *start))
        start = [a + r[name] for a, name in zip(start, sums)]
    starts = df.sparkSession.createDataFrame(starts, ", ".join(["part int", *[f"`{n}_start` long" for n in sums]]))
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{n}_inside") for n, c in sums.items()])
    return inside.join(F.broadcast(starts), "part").select(
        *df.columns, *[(F.col(f"{n}_start") + F.col(f"{n}_inside")).alias(n) for n in sums])


def _plan_in_spark(totals: DataFrame, weights: Sequence[int]) -> DataFrame:
    """The plan of any number of sources: ``fill`` by sums in order."""
    ranked = with_sums_before(totals, [F.col("source").asc_nulls_last()], {"i": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    most = F.lit(MAX_COPIES) * F.col("size")
    ranked = ranked.withColumn("weight", weight).withColumn("stop", most / F.col("weight"))
    filled = saved(with_sums_before(ranked, [F.col("stop"), F.col("i")],
                                    {"size_before": F.col("size"), "weight_before": F.col("weight")}), "filled")
    every = filled.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(every["size"]) - MAX_COPIES * F.col("size_before")) / (F.lit(every["weight"]) - F.col("weight_before"))
    # The first source in order that does not reach its limit has the level of all after it.
    first = filled.withColumn("level", level).filter("stop > level").orderBy("stop", "i").select("stop", "i", "level").head()
    target = most.cast("double")
    if first is not None:
        open_ = (F.col("stop") > first.stop) | ((F.col("stop") == first.stop) & (F.col("i") >= first.i))
        target = F.when(open_, F.least(target, F.lit(first.level) * F.col("weight"))).otherwise(target)
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    copies = F.least(F.floor("ratio"), F.lit(MAX_COPIES)).cast("long")
    plan = (filled.select("source", "size", target.alias("target")).withColumn("ratio", ratio).withColumn("copies", copies))
    p = F.when(F.col("copies") < MAX_COPIES, F.col("ratio") - F.col("copies")).otherwise(0.0)
    return saved(plan.select("source", F.col("size").alias("source_size"), "target", "copies", p.alias("p"),
                             (F.col("target") - F.col("copies") * F.col("size")).alias("due")), "plan")


def per_source(side: DataFrame, small: bool) -> DataFrame:
    """A table of one row per source as the side of a join."""
    return F.broadcast(side) if small else side


def with_plan(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """``rows`` with their source's plan."""
    side = plan.withColumnRenamed("source", "plan_source")
    return rows.join(per_source(side, small), rows["source"].eqNullSafe(side["plan_source"])).drop("plan_source")


def pareto_key() -> Column:
    """Random odds over inclusion odds, mapped to (0, 1) by q / (1 + q)."""
    odds = F.col("u") / (1 - F.col("u"))
    inclusion = F.col("p") / (1 - F.col("p"))
    return F.when(F.col("p") > 0, (odds / inclusion) / (1 + odds / inclusion))


def cuts(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """``plan`` with the cut: keys in bins before ``cut_bin`` and keys up to
    ``cut`` are taken."""
    keyed = with_plan(rows, plan, small).filter("p > 0 AND size > 0").select("source", "size", "due",
                                                                             pareto_key().alias("q"))
    keyed = keyed.withColumn("bin", F.floor(F.col("q") * BINS))
    by_bin = keyed.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("due").alias("due"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = by_bin.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    edge = saved(by_bin.filter("before <= due AND before + words > due").select("source", "bin", "before"), "edge")
    # The bins before the edge are taken whole; inside it the order is exact.
    inside = (keyed.alias("k").join(per_source(edge.alias("e"), small),
                                    F.expr("k.source <=> e.source AND k.bin = e.bin"))
              .select("k.source", "q", "size", "due", "before"))
    # Equal keys go together: sum them first, then accumulate.
    inside = inside.groupBy("source", "q").agg(F.sum("size").alias("size"), F.first("due").alias("due"),
                                               F.first("before").alias("before"))
    upto = Window.partitionBy("source").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    last = (inside.withColumn("sum", F.col("before") + F.sum("size").over(upto))
            .filter(F.col("sum") - F.col("size") / 2 <= F.col("due"))
            .groupBy("source").agg(F.max("q").alias("cut")))
    found = saved(edge.alias("e").join(last.alias("l"), F.expr("e.source <=> l.source"), "left")
                  .select("e.source", "bin", "cut"), "cuts")
    out = plan.alias("p").join(per_source(found.alias("f"), small), F.expr("p.source <=> f.source"), "left")
    # Without an edge bin every key is within what is due.
    return out.select("p.*", F.coalesce("bin", F.lit(BINS + 1)).alias("cut_bin"),
                      F.coalesce("cut", F.lit(-1.0)).alias("cut"))


def copies_taken() -> Column:
    """Copies of a row that carries its plan: whole ones and the sampled one."""
    q = pareto_key()
    drawn = (F.floor(q * BINS) < F.col("cut_bin")) | (q <= F.col("cut"))
    return F.col("copies") + F.when((F.col("p") > 0) & drawn, 1).otherwise(0)


def measured(docs: DataFrame, text: str, source: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(f"`{source}`").cast("string").alias("source"),
                       word_count(F.col(f"`{text}`")).alias("size"), draw(F.col("doc_id"), F.col(f"`{text}`")).alias("u"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, text: str = "text",
        source: str = "source") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    rows = saved(measured(docs, text, source, F.col("doc_id")), "sizes")
    plan, small = source_plan(rows, weights)
    plan = cuts(rows, plan, small)
    return with_plan(rows, plan, small).select("doc_id", "size", "source_size", "target",
                                        (copies_taken() * F.col("size")).alias("taken"))


def mixed_docs(docs: DataFrame, weights: Sequence[int] = WEIGHTS, text: str = "text",
               source: str = "source") -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it.
    The decision is a comparison in the row: no text is shuffled, unless there
    are too many sources for a broadcast."""
    rows = saved(measured(docs, text, source), "sizes")
    plan, small = source_plan(rows, weights)
    plan = cuts(rows, plan, small)
    packed = measured(docs, text, source, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = with_plan(packed, plan, small).withColumn("times", copies_taken())
    return (out.filter("times > 0")
            .select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("i"))
            .select("doc.*"))
