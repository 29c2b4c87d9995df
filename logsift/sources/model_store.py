"""Model persistence.

Every save writes a folder of its own below the model directory:

* ``terms``: (term, idf, w_0 .. w_{K-1}), at most ``MAX_FEATURES`` rows;
* ``pipeline``: the fitted pipeline, where the model has one;

and then, last, the ``manifest``: one row with the folder's name, the classes,
intercepts, n-gram size, the number of terms, whether there is a pipeline, and
the version stamp.  A reader sees the model before or the model after.

``load_model`` reads the manifest once on the driver and fails loudly when
the model is missing or unreadable (S9); a missing version is reported as
``unknown`` (S10), which is degraded observability, not a failure.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from logsift.constants import UNKNOWN_VERSION
from logsift.operators.score import TextModel


class ModelLoadError(RuntimeError):
    pass


def save_model(model: TextModel, path: str) -> None:
    """Overwrite ``path`` with the model tables."""
    spark = model.terms.sparkSession
    folder = f"save-{uuid.uuid4().hex}"
    model.terms.coalesce(1).write.parquet(f"{path}/{folder}/terms")
    pipeline = model.extra.get("pipeline")
    if pipeline is not None:
        pipeline.write().save(f"{path}/{folder}/pipeline")
    manifest = spark.createDataFrame(
        [(model.classes, [float(b) for b in model.intercepts], int(model.ngram_max),
          int(model.n_terms), model.version, folder, pipeline is not None)],
        "classes array<string>, intercepts array<double>, ngram_max int, n_terms long, "
        "version string, folder string, has_pipeline boolean")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def version_or_unknown(version: str | None) -> str:
    """S10."""
    v = (version or "").strip()
    return v or UNKNOWN_VERSION


def load_model(spark: SparkSession, path: str) -> TextModel:
    """Load once, before any query starts; raise on a missing or broken
    model."""
    try:
        rows = spark.read.parquet(f"{path}/manifest").collect()
        folder = f"{path}/{rows[0]['folder']}"
        terms = spark.read.parquet(f"{folder}/terms")
    except Exception as e:  # missing path, unreadable files
        raise ModelLoadError(f"cannot load model at {path}: {e}") from e
    if len(rows) != 1:
        raise ModelLoadError(f"model manifest at {path} has {len(rows)} rows")
    m = rows[0]
    k = len(m["classes"])
    expected = ["term", "idf"] + [f"w_{i}" for i in range(k)]
    if terms.columns != expected:
        raise ModelLoadError(f"model terms at {path} have columns {terms.columns}")
    extra = {}
    if m["has_pipeline"]:
        try:
            extra["pipeline"] = PipelineModel.load(f"{folder}/pipeline")
        except Exception as e:
            raise ModelLoadError(f"cannot load the pipeline of the model at {path}: {e}") from e
    return TextModel(classes=list(m["classes"]), terms=terms,
                     intercepts=list(m["intercepts"]), n_terms=int(m["n_terms"]),
                     version=version_or_unknown(m["version"]), ngram_max=int(m["ngram_max"]),
                     extra=extra)
