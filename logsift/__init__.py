"""logsift: log triage on Spark.

Labelled or live log records as DataFrames and streams -> TF-IDF features
over words and word pairs -> one-vs-rest logistic classifier -> category and
confidence per record -> review flag, evaluation, metrics, drift and alert
routing, reviewer feedback.
"""

__all__ = ["constants", "schemas", "session"]
