"""A fixed linear text model.

Scoring queries that are checked against an SQL oracle use this small model
instead of a trained one, so that both engines evaluate the same numbers.
The values are this project's choice; classes are in alphabetical order
(error, noise, security, warning), as a trained model orders them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from logsift.constants import BUCKETS
from logsift.operators import features
from logsift.operators.score import TextModel

FIXED_CLASSES = ["error", "noise", "security", "warning"]
FIXED_INTERCEPTS = [-1.1, 0.4, -1.6, -1.3]
FIXED_VERSION = "fixed-1"

# term, idf, weight for error, noise, security, warning (before scaling)
_TERMS = [
    ("done", 2.2, -1.0, 2.9, -0.8, -0.9),
    ("trays counted", 2.4, -0.9, 2.6, -0.9, -0.7),
    ("plan", 2.3, -0.8, 2.8, -0.7, -0.6),
    ("closed", 2.5, -0.6, 2.0, -0.4, -0.5),
    ("passed", 2.9, -0.5, 1.6, 0.4, -0.4),
    ("cleaning", 2.8, 0.2, 1.7, -0.5, 0.1),
    ("round", 1.6, -0.4, 0.6, 0.5, -0.4),
    ("opened", 2.2, -0.2, 0.7, 0.6, -0.3),
    ("halted", 2.3, 3.1, -1.0, -0.7, -0.4),
    ("stopped", 2.0, 1.9, -0.2, -0.5, -0.3),
    ("torn", 2.6, 2.1, -0.8, -0.5, -0.2),
    ("fuse", 2.6, 2.2, -0.8, -0.5, -0.2),
    ("sensor", 2.6, 2.0, -0.7, -0.4, 0.1),
    ("jammed", 2.6, 2.1, -0.8, -0.4, -0.1),
    ("no answer", 2.5, 0.9, -0.6, -0.4, 0.8),
    ("reader", 2.9, 0.9, -0.4, 0.5, -0.2),
    ("guard", 2.6, -0.7, -0.9, 3.0, -0.6),
    ("forced", 2.8, -0.6, -0.9, 2.8, -0.5),
    ("fence", 2.8, -0.6, -0.9, 2.7, -0.5),
    ("cloned", 2.8, -0.5, -0.8, 2.9, -0.6),
    ("tried", 2.9, -0.3, -0.4, 1.5, -0.3),
    ("badge", 1.7, -0.1, 0.2, 0.9, -0.5),
    ("drifting", 2.4, -0.4, -0.8, -0.7, 3.0),
    ("heat", 2.7, -0.2, -0.9, -0.6, 2.4),
    ("falling", 2.7, -0.2, -0.8, -0.6, 2.4),
    ("hum", 2.7, -0.1, -0.8, -0.6, 2.3),
    ("thin air", 2.7, -0.2, -0.8, -0.5, 2.4),
    ("reading", 1.8, -0.3, -0.6, -0.5, 1.4),
    ("second", 2.4, 0.2, 0.1, 0.1, 0.8),
    ("at", 1.3, 0.0, 0.1, 0.2, -0.1),
    ("of", 1.1, 0.1, 0.0, 0.0, 0.1),
]
# All class weights are multiplied by this factor.
WEIGHT_SCALE = 2.5
FIXED_TERMS = [(t, idf, *[round(w * WEIGHT_SCALE, 6) for w in ws]) for t, idf, *ws in _TERMS]


def fixed_model(spark: SparkSession) -> TextModel:
    k = len(FIXED_CLASSES)
    schema = "term string, idf double, " + ", ".join(f"w_{i} double" for i in range(k))
    terms = spark.createDataFrame(FIXED_TERMS, schema)
    return TextModel(classes=list(FIXED_CLASSES), terms=terms,
                     intercepts=list(FIXED_INTERCEPTS), n_terms=len(FIXED_TERMS),
                     version=FIXED_VERSION, extra={"rows": list(FIXED_TERMS)})


# A model as wide as the vocabulary cap: the corpus' own terms and IDF, weights
# by md5 bucket of term and class.
WIDE_CLASSES = ["de", "en", "es", "fr"]
WIDE_INTERCEPTS = [0.2, -0.3, 0.1, 0.0]
WIDE_VERSION = "wide-1"
WIDE_CENTRE, WIDE_SCALE = BUCKETS // 2, 1000.0


def wide_weight(term: str, label: str) -> float:
    bucket = int(hashlib.md5(f"{term}w_{label}".encode()).hexdigest()[:8], 16) % BUCKETS
    return (bucket - WIDE_CENTRE) / WIDE_SCALE


def wide_model(docs: DataFrame, key: str = "doc_id", text: str = "text") -> TextModel:
    counts, dfreq = features.frequent_counts(docs.select(key, text), key, text)
    terms, idf = features.ranked_idf(dfreq, counts.count())
    rows = [(t, x, *[wide_weight(t, c) for c in WIDE_CLASSES]) for t, x in zip(terms, idf)]
    columns = ", ".join(f"w_{i} double" for i in range(len(WIDE_CLASSES)))
    return TextModel(classes=list(WIDE_CLASSES), terms=docs.sparkSession.createDataFrame(rows, f"term string, idf double, {columns}"),
                     intercepts=list(WIDE_INTERCEPTS), n_terms=len(rows), version=WIDE_VERSION, extra={"rows": rows})
