"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

# Labelled log record as written by the batch producer (all strings).
LABELLED_LOG = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("true_label", T.StringType()),
])

# One log line inside a request.
LOG_LINE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
])

# Request envelope: {"logs": [LogLine, ...]}.
CLASSIFY_REQUEST = T.StructType([
    T.StructField("logs", T.ArrayType(LOG_LINE)),
])

# One classification result.
CLASSIFICATION_RESULT = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("needs_review", T.BooleanType()),
])

# Reviewer correction as submitted.
FEEDBACK_REQUEST = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("predicted_category", T.StringType()),
    T.StructField("true_category", T.StringType()),
])

# Stored feedback row.
FEEDBACK = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("log_id", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("predicted_category", T.StringType(), False),
    T.StructField("true_category", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType()),
])
