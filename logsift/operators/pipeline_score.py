"""Row-local scoring with a fitted Spark ML pipeline (no shuffle).

A trained model also exists as a standard ``PipelineModel``:

    SQLTransformer (tokens, 1-2 grams)
    -> CountVectorizerModel (frozen vocabulary; unknown terms ignored)
    -> ElementwiseProduct (smoothed IDF)
    -> Normalizer (L2)
    -> K binary LogisticRegressionModels (one per class, alphabetical)

Every stage works on one row at a time inside the JVM (the vocabulary is a
hash map shipped with the task), so scoring needs no shuffle at all: the
plan is scan -> project, whatever the data size.  The binary models' raw
predictions are the margins; category and confidence then come from the
same expressions as the relational scorer (``score.classify``).  The
pipeline is saved and loaded with Spark ML persistence (S8 / S9).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.constants import NGRAM_MAX, UNKNOWN_VERSION
from logsift.functions.text import terms_sql_statement
from logsift.operators.score import classify, needs_review

INTERNAL = ["_tokens", "_terms", "_tf", "_tfidf", "_features"]


def build_pipeline(terms: list[str], idf: list[float], lr_models: list, text: str = "message",
                   ngram_max: int = NGRAM_MAX) -> PipelineModel:
    stages = [
        SQLTransformer(statement=terms_sql_statement(text, "_terms", ngram_max)),
        CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="_tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf"),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol="_features"),
    ]
    for k, m in enumerate(lr_models):
        m = m.copy()
        m.setFeaturesCol("_features")
        m.setRawPredictionCol(f"_raw_{k}")
        m.setProbabilityCol(f"_prob_{k}")
        m.setPredictionCol(f"_pred_{k}")
        stages.append(m)
    return PipelineModel(stages)


def score_pipeline(df: DataFrame, pipeline: PipelineModel, classes: list[str],
                   version: str | None = None, keep_internals: bool = False) -> DataFrame:
    """``df`` + category, confidence, needs_review, model_version; one output
    row per input row, no shuffle."""
    out = pipeline.transform(df)
    k = len(classes)
    margins = [vector_to_array(F.col(f"_raw_{i}"))[1].alias(f"m_{c}")
               for i, c in enumerate(classes)]
    out = out.select(*df.columns, *margins)
    scored = classify(out, classes)
    scored = scored.withColumn("needs_review", needs_review(F.col("confidence")))
    scored = scored.withColumn("model_version",
                               F.coalesce(F.lit(version), F.lit(UNKNOWN_VERSION)))
    if keep_internals:
        return scored
    drop = [f"m_{c}" for c in classes] + [f"p_{c}" for c in classes]
    assert k == len(classes)
    return scored.drop(*drop)
