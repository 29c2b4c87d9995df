"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of characters other than the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: the session's
    checkpoint folder.  Only a local session without one gets a temporary
    folder; on a cluster the setting is required."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="logsift-llm-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/logsift-llm/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the
    lineage ends at files that survive a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _is_plain_read(df: DataFrame) -> bool:
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``(doc struct of all columns, row_file, row_no)``.  The key is the
    place of the row in its Parquet file, so it is the same in every scan,
    whatever the splits; it needs neither unique nor non-null ids.  Input that
    is not a plain file read is written to the shared folder first."""
    if not _is_plain_read(docs):
        docs = saved(docs, "rows")
    meta = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
                       meta.getField("file_path").alias("row_file"),
                       meta.getField("row_index").alias("row_no"))


def keep_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of ``keyed_rows`` whose key is in ``keys``."""
    k = keys.select("row_file", "row_no").hint("shuffle_hash")
    return rows.join(k, ["row_file", "row_no"], "left_semi").select("doc.*")


HEAVY_SHARE = 1000


def join_unique(rows: DataFrame, table: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Left join of ``rows`` to a written table with one row for each key and
    the number of its rows in ``count``.  Keys with more than one in
    ``HEAVY_SHARE`` of the counted rows, which are fewer than ``HEAVY_SHARE``,
    are joined by broadcast, so that no task gets all rows of a hot key; the
    others are left to the planner."""
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) * HEAVY_SHARE > F.lit(total)
    heavy, light = F.broadcast(table.filter(hot)), table.filter(~hot)
    rest = rows.join(heavy.select(key), key, "left_anti").join(light, key, "left")
    return rows.join(heavy, key).unionByName(rest)


def text_of(column: str | Column = "text") -> Column:
    """The text as string, null as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


class Recent(dict):
    """Results of ``make(key)`` for keys met lately: two generations of at
    most ``most`` entries; when the younger is full it becomes the elder.
    Long keys are not held."""

    def __init__(self, make, most: int, longest: int = 40):
        super().__init__()
        self.make, self.most, self.longest, self.elder = make, most, longest, {}

    def __missing__(self, key):
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.turn()
        self[key] = value
        return value

    def turn(self) -> None:
        """The younger generation becomes the elder."""
        self.elder = dict(self)
        self.clear()
