"""Training (M1-M4): TF-IDF over 1-2 grams + one-vs-rest logistic regression.

* Vocabulary and IDF are SQL aggregates (T4-T6); only the bounded
  vocabulary (at most ``MAX_FEATURES`` terms) reaches the driver.
* Features are Spark ML transformers built from that vocabulary
  (``CountVectorizerModel.from_vocabulary`` -> ``ElementwiseProduct`` by the
  smoothed IDF -> ``Normalizer``), i.e. sparse vectors computed JVM-side,
  persisted once for the K fits.
* One binary ``LogisticRegression`` per class (alphabetical order).  The
  positive class carries its balanced weight ``N / (K n_k)``, negatives
  weight 1; the L2 strength is rescaled so that Spark's weighted-mean
  objective equals ``(1/N) sum w loss + alpha/2 ||c||^2``:
  ``regParam = alpha * N / sum(w)``.  No standardisation, intercept fitted
  and not penalised.
* The result is a ``TextModel`` (term table + intercepts), scored by the
  same relational scorer as any other model.
"""

from __future__ import annotations

import math
import warnings
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.constants import ALPHA, MAX_FEATURES, NGRAM_MAX, UNKNOWN_VERSION
from logsift.functions.text import with_terms
from logsift.operators import features
from logsift.operators.pipeline_score import build_pipeline
from logsift.operators.score import TextModel


# Iterations per fit; reaching them is reported, not silent.
MAX_ITER = 1000
# Gradient norm up to which a fit counts as stationary.
STATIONARY = 1e-3
# Distinct labels that may reach the driver and be fitted.
MAX_CLASSES = 200


def fit_vocabulary(train: DataFrame, key: str, text: str, k: int = MAX_FEATURES,
                   ngram_max: int = NGRAM_MAX) -> tuple[list[str], list[float], int]:
    """(terms, idf, n_docs) of the training texts; terms in rank order."""
    tf = features.term_freq(train.select(key, text), key, text, ngram_max)
    n_docs = train.count()
    return *features.fitted_idf(tf, n_docs, k, key), n_docs


def featurize(df: DataFrame, text: str, terms: list[str], idf: list[float],
              ngram_max: int = NGRAM_MAX) -> DataFrame:
    """Adds ``features``: L2-normalised TF-IDF sparse vectors."""
    termed = with_terms(df, text, "_terms", ngram_max)
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="_tf")
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol="features")
    return norm.transform(scaled.transform(cv.transform(termed))).drop("_terms", "_tf", "_tfidf")


def balanced_weights(train: DataFrame, label: str) -> dict[str, int]:
    """Class counts (M2 input); at most ``MAX_CLASSES`` rows reach the driver."""
    rows = train.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels")
    return {r[0]: r[1] for r in rows}


def gradient_norm(fitted: DataFrame, coef, scale: float, alpha: float) -> float:
    """Norm of the objective's gradient at a fit, summed in Spark: residuals
    of either sign weigh the feature vectors."""
    r = F.col("w") * (vector_to_array("probability")[1] - F.col("label"))
    weighted = Summarizer.metrics("sum")
    s = fitted.select("features", r.alias("r")).select(
        weighted.summary(F.col("features"), F.greatest(F.col("r"), F.lit(0.0))).alias("p"),
        weighted.summary(F.col("features"), F.greatest(-F.col("r"), F.lit(0.0))).alias("n")).first()
    total = s.p["sum"].toArray() - s.n["sum"].toArray()
    g = total / scale + alpha * coef
    return math.sqrt(float((g * g).sum()))


def train_text_model(train: DataFrame, key: str = "rid", text: str = "message",
                     label: str = "true_label", alpha: float = ALPHA,
                     k: int = MAX_FEATURES, ngram_max: int = NGRAM_MAX,
                     max_iter: int = MAX_ITER, tol: float = 1e-6,
                     version: str | None = None) -> TextModel:
    """M4: fit vocabulary, IDF and K binary logistic regressions.

    ``train`` must hold complete rows: file inputs go through
    ``sources.logcsv.trainable`` first.  (A null filter here would be pushed
    below a derived view's projections and re-evaluate them.)
    """
    train = train.select(key, label, text).persist(StorageLevel.MEMORY_AND_DISK)
    terms, idf, _ = fit_vocabulary(train, key, text, k, ngram_max)
    counts = balanced_weights(train, label)
    n = sum(counts.values())
    classes = sorted(counts)                                    # M1
    n_classes = len(classes)
    feats = (featurize(train.select(label, text), text, terms, idf, ngram_max)
             .select(label, "features").persist(StorageLevel.MEMORY_AND_DISK))
    def fit_one(c):
        pos_w = n / (n_classes * counts[c])                     # M2
        sum_w = counts[c] * pos_w + (n - counts[c])
        reg = alpha * n / sum_w
        data = feats.select(
            "features",
            (F.col(label) == F.lit(c)).cast("double").alias("label"),
            F.when(F.col(label) == F.lit(c), F.lit(pos_w)).otherwise(F.lit(1.0)).alias("w"))
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w",
                                regParam=reg, elasticNetParam=0.0, standardization=False,
                                fitIntercept=True, maxIter=max_iter, tol=tol)
        m = lr.fit(data)                                        # M3
        coef = m.coefficients.toArray()
        iterations = int(m.summary.totalIterations)
        if iterations >= max_iter:
            warnings.warn(f"fit of class {c!r} stopped at its limit of {max_iter} iterations", stacklevel=2)
        norm = gradient_norm(m.transform(data), coef, n, alpha)
        return coef, float(m.intercept), (c, counts[c], pos_w, reg, len(terms), iterations < max_iter,
                                          norm < STATIONARY), m

    try:
        # The K binary fits are independent: they run as concurrent Spark
        # jobs over the same persisted features.
        with ThreadPoolExecutor(max_workers=max(1, n_classes)) as pool:
            fitted = list(pool.map(fit_one, classes))
    finally:
        feats.unpersist()
        train.unpersist()
    weights = [f[0] for f in fitted]
    intercepts = [f[1] for f in fitted]
    summary = [f[2] for f in fitted]
    pipeline = build_pipeline(terms, idf, [f[3] for f in fitted], text, ngram_max)
    rows = [(t, float(idf[j]), *[float(w[j]) for w in weights]) for j, t in enumerate(terms)]
    spark = train.sparkSession
    schema = "term string, idf double, " + ", ".join(f"w_{i} double" for i in range(n_classes))
    term_df = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
    return TextModel(classes=classes, terms=term_df, intercepts=intercepts, n_terms=len(rows),
                     version=version or UNKNOWN_VERSION, ngram_max=ngram_max,
                     extra={"summary": summary, "n_train": n, "pipeline": pipeline, "rows": rows})


def summary_frame(model: TextModel) -> DataFrame:
    """One row per class: (class, label_index, n, positive_weight,
    reg_param, n_terms, converged, stationary)."""
    spark = model.terms.sparkSession
    rows = [(c, i, *rest) for i, (c, *rest) in enumerate(model.extra["summary"])]
    return spark.createDataFrame(
        rows, "class string, label_index int, n long, positive_weight double, "
              "reg_param double, n_terms int, converged boolean, stationary boolean")
