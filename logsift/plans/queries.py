"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the input tables (or views Spark derives from them) in
full.  Doubles are rounded to 6 digits and timestamps are returned without
a zone so that results compare with an SQL engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.operators import alerts, evaluate, feedback, features, metrics, rollup, validate
from logsift.operators.corpus import (LABELLED_COLUMNS, class_mix_resample)
from logsift.operators.score import score
from logsift.plans import views
from logsift.plans.fixed_model import wide_model
from logsift.session import checkpoint_dir
from logsift.sources import envelope, logcsv
from logsift.sources.tables import read_table

R = 6
# Target class mix for document resampling (same weights as the log classes,
# assigned to the languages from most to least common).
LANG_TARGET = {"en": 0.70, "fr": 0.15, "de": 0.10, "es": 0.05}


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to ``R`` digits; timestamps without zone."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f.name), R).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# --- corpus, projections, predicates ---------------------------------------------

def q_log_scan(spark, sf):
    return views.logs(spark, sf).select(*LABELLED_COLUMNS)


def q_log_scan_csv(spark, sf):
    """S1 over CSV files that hold the log view and some bad lines."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/logsift/csv-{uuid.uuid4().hex}"
    views.csv_lines(views.logs(spark, sf)).write.text(path)
    read = logcsv.read_labelled_logs(spark, path, multi_line=False, header=False, keep_bad=True)
    good, bad = logcsv.split_bad(read)
    return good.unionByName(bad, allowMissingColumns=True)


def q_label_mask(spark, sf):
    lv = views.logs(spark, sf).select("log_id", *LABELLED_COLUMNS)
    return validate.mask_label(lv)


def q_validate_logs(spark, sf):
    lv = views.defective(views.logs(spark, sf))
    return validate.with_validation(lv).select("log_id", "is_valid", "reason")


def q_level_from_category(spark, sf):
    return views.logs(spark, sf).groupBy("true_label", "level").agg(
        F.count(F.lit(1)).alias("n"))


def q_weighted_mix(spark, sf):
    lv = views.logs(spark, sf)
    c = lv.groupBy("true_label").agg(F.count(F.lit(1)).alias("n"))
    # Share over the per-class table only.
    return rounded(c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))


def q_render_logs(spark, sf):
    return views.logs(spark, sf).select("log_id", "true_label", "message")


def q_ambiguous_share(spark, sf):
    lv = views.logs(spark, sf)
    return rounded(lv.groupBy("true_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("ambiguous").alias("n_ambiguous"),
        F.avg(F.col("ambiguous").cast("double")).alias("share")))


def q_train_test_split(spark, sf):
    return views.logs(spark, sf).select("log_id", "split")


def q_log_id(spark, sf):
    return views.logs(spark, sf).select("rid", "log_id")


def q_version_fallback(spark, sf):
    s = views.with_track(views.scored(spark, sf))
    return s.groupBy("track", "model_version").agg(F.count(F.lit(1)).alias("n"))


def q_class_mix_resample(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    return class_mix_resample(docs, "lang", "doc_id", LANG_TARGET)


# --- envelopes ---------------------------------------------------------------------

def q_envelope_explode(spark, sf):
    lv = views.with_requests(views.logs(spark, sf))
    return envelope.explode_requests(envelope.build_requests(lv))


def q_envelope_collect(spark, sf):
    s = views.with_requests(views.scored(spark, sf))
    res = envelope.collect_results(s)
    return res.select(
        "request_id",
        F.size("results").alias("n_results"),
        F.array_join(F.transform("results", lambda r: r["log_id"]), ",").alias("log_ids"),
        F.array_join(F.transform("results", lambda r: r["category"]), ",").alias("categories"),
        F.size(F.filter("results", lambda r: r["needs_review"])).alias("n_review"))


# --- text features (documents) -----------------------------------------------------

def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text")


def q_tokenize(spark, sf):
    d = features.tokenize(_docs(spark, sf))
    return d.select("doc_id", F.size("tokens").alias("n_tokens"),
                    F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def q_ngrams(spark, sf):
    d = features.with_ngrams(_docs(spark, sf))
    return d.select("doc_id", F.size("terms").alias("n_terms"),
                    F.size(F.filter("terms", lambda t: F.instr(t, " ") > 0)).alias("n_bigrams"),
                    F.md5(F.array_join("terms", "|")).alias("terms_md5"))


def q_term_freq(spark, sf):
    return features.term_freq(_docs(spark, sf))


def q_doc_freq(spark, sf):
    return features.doc_freq(features.term_freq(_docs(spark, sf)))


def q_vocabulary_topk(spark, sf):
    _, dfreq = features.frequent_counts(_docs(spark, sf))
    return features.vocabulary(dfreq)


def q_idf(spark, sf):
    docs = _docs(spark, sf)
    n_docs = docs.select(F.count(F.lit(1))).scalar()      # scalar subquery, lazy
    _, dfreq = features.frequent_counts(docs)
    return rounded(features.idf_table(dfreq, n_docs))


def q_tfidf(spark, sf):
    """A table of counted documents serves the fit and the vectors."""
    counts, dfreq = features.frequent_counts(_docs(spark, sf))
    return rounded(features.tfidf(counts, features.fit_frequencies(dfreq, counts.count())))


def q_oov_transform(spark, sf):
    docs = views.documents(spark, sf).select("doc_id", "split", "text")
    counts, dfreq = features.frequent_counts(docs, fit_on="split = 'train'")
    train, test = (counts.where(F.col("split") == s) for s in ("train", "test"))
    return rounded(features.tfidf(test, features.fit_frequencies(dfreq, train.count())))


def q_label_index(spark, sf):
    return evaluate.label_index(read_table(spark, sf, "documents"), "lang")


def q_class_weights(spark, sf):
    docs = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels")
    parts = [
        evaluate.class_weights(docs, "lang").withColumn("task", F.lit("lang")),
        evaluate.class_weights(lab, "toxic").withColumn("task", F.lit("toxic")),
        evaluate.class_weights(lab, "quality").withColumn("task", F.lit("quality")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(out.select("task", "class", "n", "weight"))


def q_train_classifier(spark, sf):
    """M3 / M4 on the training split of the log view (rows-only check)."""
    from logsift.operators.train import summary_frame, train_text_model
    train = views.logs(spark, sf).where(F.col("split") == "train")
    model = train_text_model(train, key="rid", text="message", label="true_label")
    return rounded(summary_frame(model))


# --- scoring (fixed model) ------------------------------------------------------------

def _scored(spark, sf, internals=False, split=None):
    return views.scored(spark, sf, internals=internals, split=split)


def q_margin(spark, sf):
    s = _scored(spark, sf, internals=True)
    return rounded(s.select("log_id", *[c for c in s.columns if c.startswith("m_")]))


def q_predict_category(spark, sf):
    return _scored(spark, sf).select("log_id", "category")


def q_class_probability(spark, sf):
    s = _scored(spark, sf, internals=True)
    return rounded(s.select("log_id", *[c for c in s.columns if c.startswith("p_")]))


def q_confidence(spark, sf):
    return rounded(_scored(spark, sf).select("log_id", "category", "confidence"))


def q_score_logs(spark, sf):
    s = _scored(spark, sf)
    return rounded(s.select("log_id", "timestamp", "source", "level", "message", "category",
                            "confidence", "needs_review", "model_version"))


def q_score_documents_wide(spark, sf):
    """A model of up to 5000 terms over whole documents."""
    docs = _docs(spark, sf)
    s = score(docs, wide_model(docs), text="text", keep_internals=True)
    return rounded(s.select("doc_id", "category", "confidence", "needs_review", "model_version",
                            *[c for c in s.columns if c.startswith("m_")]))


def q_needs_review(spark, sf):
    return rounded(_scored(spark, sf).select("log_id", "confidence", "needs_review"))


def q_review_queue(spark, sf):
    q = validate.review_queue(_scored(spark, sf))
    return rounded(q.select("log_id", "timestamp", "category", "confidence", "needs_review"))


# --- evaluation (test split) -------------------------------------------------------

def _test_scored(spark, sf):
    return _scored(spark, sf, split="test")


def q_confusion_matrix(spark, sf):
    return evaluate.confusion(_test_scored(spark, sf))


def q_class_report(spark, sf):
    return rounded(evaluate.class_report(_test_scored(spark, sf)).drop("tp"))


def q_report_averages(spark, sf):
    return rounded(evaluate.report_averages(evaluate.class_report(_test_scored(spark, sf))))


def q_low_confidence_count(spark, sf):
    return evaluate.low_confidence(_test_scored(spark, sf))


def q_review_gate(spark, sf):
    return evaluate.review_gate(_test_scored(spark, sf))


# --- metrics -------------------------------------------------------------------------

def q_request_counter(spark, sf):
    return metrics.request_counter(_scored(spark, sf))


def q_confidence_histogram(spark, sf):
    return rounded(metrics.confidence_histogram(_scored(spark, sf)))


def q_latency_histogram(spark, sf):
    return rounded(metrics.latency_histogram(views.latencies(spark, sf)))


def q_model_loaded_gauge(spark, sf):
    return metrics.model_loaded_gauge(views.lifecycle(spark, sf))


def q_metrics_snapshot(spark, sf):
    return rounded(metrics.served_metrics(views.served(spark, sf)))


def q_rolling_confidence(spark, sf):
    return rounded(metrics.rolling_mean(_scored(spark, sf)))


def q_latency_percentiles(spark, sf):
    return rounded(metrics.latency_percentiles(views.latencies(spark, sf)))


def q_canary_compare(spark, sf):
    return rounded(metrics.canary_compare(views.with_track(_scored(spark, sf))))


def q_distribution_shift(spark, sf):
    lv = views.logs(spark, sf)
    ref = lv.where(F.col("split") == "train").select(F.col("true_label").alias("category"))
    cur = _test_scored(spark, sf).select("category")
    return rounded(metrics.distribution_shift(ref, cur))


# --- alerts ------------------------------------------------------------------------------

def q_alert_routing(spark, sf):
    a = alerts.route(_scored(spark, sf))
    return rounded(a.select("log_id", "category", "confidence", "severity"))


def q_drift_alert(spark, sf):
    return rounded(alerts.drift_alerts(metrics.rolling_mean(_scored(spark, sf))))


def q_alert_payload(spark, sf):
    return alerts.payload(alerts.route(_scored(spark, sf)))


def q_alert_summary(spark, sf):
    return rollup.alert_summary(rollup.rollup(_scored(spark, sf)))


# --- feedback --------------------------------------------------------------------------

def _reviews(spark, sf):
    return views.reviews(_scored(spark, sf))


def q_correction_rate(spark, sf):
    return rounded(feedback.correction_rate(feedback.latest_feedback(_reviews(spark, sf))))


def q_correction_pairs(spark, sf):
    return rounded(feedback.correction_pairs(feedback.latest_feedback(_reviews(spark, sf))))


def q_latest_feedback(spark, sf):
    return rounded(feedback.latest_feedback(_reviews(spark, sf)).select(
        "log_id", "id", "predicted_category", "true_category", "timestamp"))


def q_retraining_set(spark, sf):
    train = views.logs(spark, sf).where(F.col("split") == "train")
    latest = feedback.latest_feedback(_reviews(spark, sf))
    return feedback.retraining_set(train, latest)


def q_review_backlog(spark, sf):
    return rounded(feedback.open_records(views.flagged_entries(_scored(spark, sf))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}

__all__ = ["QUERIES", "rounded"]
