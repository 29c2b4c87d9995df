"""Views derived from the input tables, shared by the registered queries.

* ``logs``: the labelled log view over ``events`` (one record per event).
* ``scored``: ``logs`` scored by a text model (fixed model by default).
* ``reviews``: reviewer feedback rows derived from flagged scored records.
* ``lifecycle``: model load / unload rows derived from ``events``.
* ``latencies``: per-request durations in seconds from ``events.value``.
* ``documents``: the document corpus with a deterministic train / test split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.constants import (BUCKETS, CANARY_SHARE, DOUBLE_REVIEW_SHARE, REQUEST_SIZE,
                               REVIEWED_SHARE, UNKNOWN_VERSION)
from logsift.functions.buckets import bucket
from logsift.operators.corpus import log_view, split_of
from logsift.operators.score import TextModel, score
from logsift.operators.validate import REQUIRED
from logsift.plans.fixed_model import fixed_model
from logsift.sources import logcsv
from logsift.sources.tables import events, read_table

# Share of records made invalid for the validating queries.
DEFECT_SHARE = 0.02
LIFECYCLE_VERSIONS = ["v1", "v2", "v3"]

def logs(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return log_view(events(spark, sf_dir), carry=carry).withColumn("split", split_of("rid"))


def scored(spark: SparkSession, sf_dir: str, model: TextModel | None = None,
           split: str | None = None, internals: bool = False) -> DataFrame:
    lv = logs(spark, sf_dir)
    if split is not None:
        lv = lv.where(F.col("split") == F.lit(split))
    return score(lv, model or fixed_model(spark), keep_internals=internals)


def defective(lv: DataFrame) -> DataFrame:
    """The log view with one required field missing in a share of the rows."""
    broken = bucket(F.col("rid"), "defect") < F.lit(int(round(DEFECT_SHARE * BUCKETS)))
    which = bucket(F.col("rid"), "field") % F.lit(len(REQUIRED))
    gone = {c: F.when(~(broken & (which == F.lit(i))), F.col(c)).alias(c) for i, c in enumerate(REQUIRED)}
    return lv.select(*[gone.get(c, F.col(c)) for c in lv.columns])


def csv_lines(lv: DataFrame) -> DataFrame:
    """The log view as CSV lines, of which a share is cut short and a share
    has a field too many."""
    b = bucket(F.col("rid"), "csv")
    cut = F.lit(int(round(DEFECT_SHARE * BUCKETS)))
    line = logcsv.csv_line()
    return lv.select(F.when(b < cut, F.concat_ws(",", "timestamp", "source"))
                     .when(b < 2 * cut, F.concat(line, F.lit(",more"))).otherwise(line).alias("value"))


def with_requests(df: DataFrame) -> DataFrame:
    """Records grouped into requests of ``REQUEST_SIZE`` consecutive ids."""
    return (df.withColumn("request_id", (F.col("rid") / F.lit(REQUEST_SIZE)).cast("long"))
            .withColumn("pos", (F.col("rid") % F.lit(REQUEST_SIZE)).cast("int")))


def with_track(df: DataFrame) -> DataFrame:
    """Canary / stable track by md5 bucket; the canary build carries no
    version stamp, so its records report ``unknown``."""
    canary = bucket(F.col("rid"), "track") < F.lit(int(round(CANARY_SHARE * BUCKETS)))
    return (df.withColumn("track", F.when(canary, F.lit("canary")).otherwise(F.lit("stable")))
            .withColumn("model_version",
                        F.coalesce(F.when(~canary, F.col("model_version")),
                                   F.lit(UNKNOWN_VERSION))))


def reviews(scored_df: DataFrame) -> DataFrame:
    """Feedback rows: a share of flagged records got a correction an hour
    after the event (true label); a share of those had an earlier one at 30
    minutes that kept the prediction, so duplicates exist per ``log_id``."""
    return flagged_entries(scored_df, with_records=False).select("entry.*")


def flagged_entries(scored_df: DataFrame, with_records: bool = True) -> DataFrame:
    """Flagged records and their feedback from one pass: ``(log_id, category,
    confidence, entry)``, a row for each record (``entry`` null) and one for
    each of its feedback rows."""
    rid = F.col("rid")

    def fed(n: int, label: str, after: str):
        return F.struct((rid * 2 + n).alias("id"), "log_id", "message", F.col("category").alias("predicted_category"),
                        F.col(label).alias("true_category"), (F.col("event_time") + F.expr(f"INTERVAL {after}")).alias("timestamp"))

    reviewed = bucket(rid, "reviewed") < F.lit(int(round(REVIEWED_SHARE * BUCKETS)))
    twice = reviewed & (bucket(rid, "double") < F.lit(int(round(DOUBLE_REVIEW_SHARE * BUCKETS))))
    last, first = fed(1, "true_label", "1 HOUR"), fed(0, "category", "30 MINUTES")
    entries = F.when(twice, F.array(last, first)).when(reviewed, F.array(last))
    flagged = scored_df.where(F.col("needs_review"))
    if with_records:
        entries = F.concat(F.array(F.lit(None).cast(_FEEDBACK)), F.coalesce(entries, F.array().cast(f"array<{_FEEDBACK}>")))
    return flagged.select("log_id", "category", "confidence", F.explode(entries).alias("entry"))


_FEEDBACK = ("struct<id: bigint, log_id: string, message: string, predicted_category: string, true_category: string, "
             "timestamp: timestamp>")


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored records with their request's duration and the model state that
    their event reports, from one scan of ``events``."""
    s = score(logs(spark, sf_dir, carry=("event_type", "value")), fixed_model(spark))
    return s.select("category", "confidence", (F.col("value") / F.lit(1000.0)).alias("latency_s"),
                    F.when(F.col("event_type").isin("signup", "error"), reported_version(F.col("rid"))).alias("version"),
                    F.col("event_time").alias("ts"), F.col("rid").alias("seq"),
                    (F.col("event_type") == "signup").cast("int").alias("state"))


def reported_version(key: Column) -> Column:
    versions = F.array(*[F.lit(v) for v in LIFECYCLE_VERSIONS])
    return F.element_at(versions, (bucket(key, "version") % F.lit(len(LIFECYCLE_VERSIONS))).cast("int") + 1)


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, ts, seq, value): a ``signup`` event loads a model version
    (1), an ``error`` event unloads it (0); the version is an md5 pick."""
    ev = events(spark, sf_dir).where(F.col("event_type").isin("signup", "error"))
    return ev.select(reported_version(F.col("event_id")).alias("version"), "ts", F.col("event_id").alias("seq"),
                     F.when(F.col("event_type") == "signup", F.lit(1)).otherwise(F.lit(0))
                     .alias("value"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request durations: ``events.value`` read as milliseconds."""
    return events(spark, sf_dir).select(
        "event_id", (F.col("value") / F.lit(1000.0)).alias("latency_s"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.withColumn("split", split_of("doc_id"))
