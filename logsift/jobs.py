"""Training and evaluation over files.

    python -m logsift.jobs train LOGS MODEL [VERSION]
    python -m logsift.jobs evaluate LOGS MODEL

``LOGS`` are labelled logs (S1), CSV or Parquet by the ending of the path.  A
missing path, or one without a single trainable record, is ``MissingInput``.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators import evaluate
from logsift.operators.pipeline_score import score_pipeline
from logsift.operators.score import TextModel, score
from logsift.operators.train import train_text_model
from logsift.sources import logcsv, model_store


class MissingInput(FileNotFoundError):
    """Labelled logs that are not there, or hold nothing to learn from."""


def labelled(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Trainable records of the files at ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise MissingInput(f"no labelled logs at {path}")
    fmt = "parquet" if path.rstrip("/").endswith(".parquet") else "csv"
    read = logcsv.read_labelled_logs(spark, path, fmt, multi_line=multi_line, keep_bad=fmt == "csv")
    rows = logcsv.trainable(logcsv.split_bad(read)[0] if fmt == "csv" else read)
    if rows.isEmpty():
        raise MissingInput(f"no record with message and label at {path}")
    return rows


def train(spark: SparkSession, logs: str, model: str, version: str | None = None, **options) -> TextModel:
    """Fit on the files at ``logs`` and save at ``model``; returns the model
    with its summary, which says whether every fit converged."""
    rows = labelled(spark, logs).withColumn("rid", F.monotonically_increasing_id())
    fitted = train_text_model(rows, version=version, **options)
    model_store.save_model(fitted, model)
    return fitted


def evaluated(spark: SparkSession, logs: str, model: str) -> dict[str, DataFrame]:
    """``report`` (E2), ``averages`` (E3), ``confusion`` (E1) and ``gate`` (E5)
    of a saved model over the files at ``logs``."""
    loaded = model_store.load_model(spark, model)
    rows = labelled(spark, logs)
    pipeline = loaded.extra.get("pipeline")
    scored = score_pipeline(rows, pipeline, loaded.classes, loaded.version) if pipeline is not None else score(rows, loaded)
    report = evaluate.class_report(scored)
    return {"confusion": evaluate.confusion(scored), "report": report.drop("tp"),
            "averages": evaluate.report_averages(report), "gate": evaluate.review_gate(scored)}


def main(args: list[str]) -> int:
    if len(args) not in (3, 4) or args[0] not in ("train", "evaluate"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("logsift").getOrCreate()
    try:
        if args[0] == "train":
            fitted = train(spark, *args[1:])
            for c, n, *_, converged, stationary in fitted.extra["summary"]:
                print(f"{c}: {n} records, converged {converged}, stationary {stationary}")
            return 0
        out = evaluated(spark, *args[1:3])
        for name in ("report", "averages", "gate"):
            out[name].show(truncate=False)
        return 0 if out["gate"].first().passed else 1
    except (MissingInput, model_store.ModelLoadError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
