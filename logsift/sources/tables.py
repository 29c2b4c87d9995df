"""Reading the input tables (Parquet, one directory per scale)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a plain scan, from the planner's statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Deal a small scan over the default parallelism.

    A file's rows are read by the split that holds the middle of their row
    group, so a small file with one row group is one task, however many splits
    it has.  A scan of at most ``spark.sql.files.maxPartitionBytes`` in fewer
    files than the parallelism is dealt row by row, which never moves more than
    those bytes; every larger scan is left as the reader splits it.
    """
    spark = df.sparkSession
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    parallelism = spark.sparkContext.defaultParallelism
    if scan_bytes(df) > most or len(df.inputFiles()) >= parallelism:
        return df
    return df.repartition(parallelism)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` as a zone-aware timestamp (session zone UTC),
    which watermarks and time windows require."""
    df = read_table(spark, sf_dir, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))
