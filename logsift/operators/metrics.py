"""Metrics (A1-A9) as aggregates over scored records.

Every metric is a single aggregate (partial aggregation map-side) or an
aggregate over a small intermediate (minutes, classes, tracks); no
unpartitioned window runs over records.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.constants import (CONFIDENCE_BUCKETS, LATENCY_BUCKETS, METRIC_CONFIDENCE,
                               METRIC_LATENCY, METRIC_LOADED, METRIC_REQUESTS,
                               SHIFT_EPSILON, STATUS_OK)
from logsift.functions.histogram import bound_columns, histogram_entries, histogram_rows
from logsift.operators.rollup import category_labels, counter_entry, label_text


def request_counter(scored: DataFrame) -> DataFrame:
    """A1: (category, status_code, value) count of scored records."""
    return scored.groupBy("category").agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select("category", F.lit(STATUS_OK).alias("status_code"), "value")


def confidence_histogram(scored: DataFrame) -> DataFrame:
    """A2: cumulative confidence histogram rows (metric, le, value)."""
    return histogram_rows(scored, "confidence", CONFIDENCE_BUCKETS, METRIC_CONFIDENCE)


def latency_histogram(latencies: DataFrame, col: str = "latency_s") -> DataFrame:
    """A3: the same operator on a duration in seconds."""
    return histogram_rows(latencies, col, LATENCY_BUCKETS, METRIC_LATENCY)


def model_loaded_gauge(lifecycle: DataFrame) -> DataFrame:
    """A4: latest state (1 loaded / 0 unloaded) per version from
    (version, ts, seq, value) rows; ``max_by`` keeps one candidate per
    version per partition, so a hot version does not skew."""
    return lifecycle.groupBy("version").agg(
        F.max_by("value", F.struct("ts", "seq")).cast("double").alias("value"))


def served_metrics(served: DataFrame) -> DataFrame:
    """One (metric, labels, le, value) table in one pass over served
    records, which carry ``category``, ``confidence``, ``latency_s`` and the
    state they report: ``version, ts, seq, state`` (version null: none).

    The latest state of a version is the one of the largest (ts, seq, state),
    taken as one number so that the aggregate keeps fixed-size buffers.
    """
    wide = "decimal(38,0)"
    rank = ((F.unix_micros(F.col("ts").cast("timestamp")).cast(wide) * F.lit(10 ** 12).cast("decimal(13,0)")
             + F.col("seq").cast(wide)) * F.lit(2).cast("decimal(1,0)") + F.col("state").cast(wide)).cast(wide)
    small = served.groupBy("category", "version").agg(
        F.count("category").alias("n"), *bound_columns(F.col("confidence"), CONFIDENCE_BUCKETS, "c_"),
        *bound_columns(F.col("latency_s"), LATENCY_BUCKETS, "l_"), F.max(rank).alias("rank"))
    none = F.lit(None).cast("string")
    plain = [F.when(F.col("category").isNotNull(), counter_entry(category_labels())),
             *histogram_entries(METRIC_CONFIDENCE, CONFIDENCE_BUCKETS, "c_", labels=True),
             *histogram_entries(METRIC_LATENCY, LATENCY_BUCKETS, "l_", labels=True)]
    state = F.struct(F.lit(METRIC_LOADED).alias("metric"), label_text(("version", F.col("version"))).alias("labels"),
                     none.alias("le"), F.lit(0.0).alias("value"), F.col("rank").alias("rank"))
    entries = [F.when(e.isNotNull(), F.struct(e["metric"].alias("metric"), e["labels"].alias("labels"), e["le"].alias("le"),
                                              e["value"].alias("value"), F.lit(None).cast(wide).alias("rank"))) for e in plain]
    rows = small.select(F.inline(F.array(*entries, F.when(F.col("version").isNotNull(), state)))).where("metric IS NOT NULL")
    sums = rows.groupBy("metric", "labels", "le").agg(F.sum("value").alias("value"), F.max("rank").alias("rank"))
    return sums.select("metric", "labels", "le", F.when(F.col("rank").isNotNull(), F.pmod("rank", F.lit(2)).cast("double"))
                       .otherwise(F.col("value")).alias("value"))


def metrics_snapshot(counter: DataFrame, conf_hist: DataFrame, lat_hist: DataFrame,
                     gauge: DataFrame) -> DataFrame:
    """S11 from its four parts, where these are tables already."""
    none = F.lit(None).cast("string")
    a = counter.select(F.lit(METRIC_REQUESTS).alias("metric"),
                       label_text(("category", F.col("category")), ("status_code", F.col("status_code"))).alias("labels"),
                       none.alias("le"), "value")
    b, c = (h.select("metric", F.lit("{}").alias("labels"), "le", "value") for h in (conf_hist, lat_hist))
    d = gauge.select(F.lit(METRIC_LOADED).alias("metric"), label_text(("version", F.col("version"))).alias("labels"),
                     none.alias("le"), "value")
    return a.unionByName(b).unionByName(c).unionByName(d)


def rolling_mean(df: DataFrame, ts: str = "event_time", value: str = "confidence",
                 window_minutes: int = 5, slide_minutes: int = 1) -> DataFrame:
    """A5: mean of ``value`` over sliding windows (default 5 min, 1 min
    slide), aligned to the epoch like ``window()``.

    Each record goes into one partial (sum, count) per slide slot; each
    partial then feeds the ``window / slide`` windows that contain it.  This
    is ``window()``'s result without multiplying the records, and without an
    unpartitioned ``Window.orderBy``.  Empty windows produce no row.
    """
    if window_minutes % slide_minutes:
        raise ValueError("window must be a multiple of the slide")
    slide_s = slide_minutes * 60
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(slide_s * 1_000_000))
    partial = (df.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
               .groupBy(slot.alias("slot"))
               .agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c")))
    k = window_minutes // slide_minutes
    spread = (partial.select("slot", "s", "c", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
                             .alias("back"))
              .select((F.col("slot") - F.col("back")).alias("start_slot"), "s", "c"))
    win = spread.groupBy("start_slot").agg(F.sum("s").alias("s"), F.sum("c").alias("n"))
    start = F.timestamp_seconds(F.col("start_slot") * F.lit(slide_s))
    return win.select(start.cast("timestamp_ntz").alias("window_start"),
                      (start + F.expr(f"INTERVAL {window_minutes} MINUTES"))
                      .cast("timestamp_ntz").alias("window_end"),
                      F.col("n"), (F.col("s") / F.col("n")).alias("avg_confidence"))


# Values of one range that a quantile search may bring to the driver, as
# distinct values with their counts.
GATHER_VALUES = 200_000


def exact_quantiles(df: DataFrame, col: str, shares: list[float], accuracy: int = 10_000) -> list[float | None]:
    """The values of rank ``ceil(p * n)`` among the finite values, for all
    ``shares`` p at once.

    One pass sketches a range around every rank; one pass counts, for all ranges
    together, the values below, at and between their ends, which tells in which
    range, or at which end, each rank lies; one pass counts the distinct values
    inside the ranges that hold a rank.  Only where such a range has more than
    ``GATHER_VALUES`` values it is sketched and counted again, so the search
    ends whatever the sketch says.  Nothing is sorted or gathered but those
    values.
    """
    v = df.select(F.col(col).cast("double").alias("v")).where(F.abs("v") < F.lit(math.inf))
    found: dict[int, float] = {}
    open_ranks = [(i, p, None, -math.inf, math.inf, None) for i, p in enumerate(shares)]
    while open_ranks:
        # Ends around every rank that is still searched.
        within = [(F.col("v") > F.lit(lo)) & (F.col("v") < F.lit(hi)) for _, _, _, lo, hi, _ in open_ranks]
        asked = []
        for (i, p, rank, lo, hi, n), here in zip(open_ranks, within):
            share, off = (p if rank is None else rank / n), 2 / accuracy
            ends = F.array(F.lit(max(share - off, 0.0)), F.lit(min(share + off, 1.0)))
            asked += [F.percentile_approx(F.when(here, F.col("v")), ends, accuracy).alias(f"e{i}")]
        ends = v.agg(F.count(F.lit(1)).alias("all"), *asked).first()
        if not ends["all"]:
            break
        counts = []
        for (i, *_), here in zip(open_ranks, within):
            a, b = (F.lit(e) for e in ends[f"e{i}"])
            counts += [F.count_if(here & c).alias(f"{k}{i}") for k, c in (
                ("below", F.col("v") < a), ("upto", F.col("v") <= a), ("before", F.col("v") < b), ("through", F.col("v") <= b),
                ("inside", F.lit(True)))]
        seen = v.agg(*counts).first()
        left, few = [], []
        for i, p, rank, lo, hi, _ in open_ranks:
            a, b = ends[f"e{i}"]
            rank = rank or max(1, math.ceil(p * ends["all"]))
            below, upto, before, through, inside = (seen[f"{k}{i}"] for k in ("below", "upto", "before", "through", "inside"))
            if below < rank <= upto:
                found[i] = a
            elif before < rank <= through:
                found[i] = b
            else:
                now = ((i, p, rank, lo, a, below) if rank <= below else (i, p, rank - upto, a, b, before - upto)
                       if rank <= before else (i, p, rank - through, b, hi, inside - through))
                (few if now[5] <= GATHER_VALUES else left).append(now)
        if few:
            held = [(F.col("v") > F.lit(lo)) & (F.col("v") < F.lit(hi)) for _, _, _, lo, hi, _ in few]
            near = held[0]
            for h in held[1:]:
                near = near | h
            values = sorted(tuple(r) for r in v.where(near).groupBy("v").count().collect())
            for i, _, rank, lo, hi, _ in few:
                for value, n in values:
                    if lo < value < hi:
                        rank -= n
                        if rank <= 0:
                            found[i] = value
                            break
        open_ranks = left
    return [found.get(i) for i in range(len(shares))]


def exact_quantile(df: DataFrame, col: str, p: float, accuracy: int = 10_000) -> float | None:
    return exact_quantiles(df, col, [p], accuracy)[0]


def latency_percentiles(latencies: DataFrame, col: str = "latency_s") -> DataFrame:
    """Exact P90 / P95 at every size (``exact_quantiles``)."""
    row = tuple(exact_quantiles(latencies, col, [0.9, 0.95]))
    return latencies.sparkSession.createDataFrame([row], "p90 double, p95 double")


def canary_compare(scored: DataFrame, track: str = "track") -> DataFrame:
    """Canary vs stable confidence in one pass (conditional aggregates)."""
    def by(t):
        return F.when(F.col(track) == F.lit(t), F.col("confidence"))
    out = scored.agg(
        F.count(by("canary")).alias("canary_n"), F.count(by("stable")).alias("stable_n"),
        F.avg(by("canary")).alias("canary_avg"), F.avg(by("stable")).alias("stable_avg"),
        F.stddev_samp(by("canary")).alias("canary_stddev"),
        F.stddev_samp(by("stable")).alias("stable_stddev"))
    return out.withColumn("delta_avg", F.col("canary_avg") - F.col("stable_avg"))


def shares(df: DataFrame, col: str) -> DataFrame:
    """(bucket, n, share) of a categorical column; the window runs over the
    per-bucket table only."""
    c = df.groupBy(F.col(col).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def distribution_shift(reference: DataFrame, current: DataFrame, col: str = "category",
                       eps: float = SHIFT_EPSILON) -> DataFrame:
    """PSI and KL(current || reference) between two categorical mixes;
    a bucket missing on one side counts as share ``eps``."""
    r = shares(reference, col).select("bucket", F.col("n").alias("n_ref"),
                                      F.col("share").alias("p_ref"))
    c = shares(current, col).select("bucket", F.col("n").alias("n_cur"),
                                    F.col("share").alias("p_cur"))
    j = r.join(c, "bucket", "full_outer")
    pr = F.greatest(F.coalesce("p_ref", F.lit(0.0)), F.lit(eps))
    pc = F.greatest(F.coalesce("p_cur", F.lit(0.0)), F.lit(eps))
    ln = F.log(pc / pr)
    return j.agg(F.sum(F.coalesce("n_ref", F.lit(0))).alias("n_ref"),
                 F.sum(F.coalesce("n_cur", F.lit(0))).alias("n_cur"),
                 F.sum((pc - pr) * ln).alias("psi"),
                 F.sum(pc * ln).alias("kl"))
