"""Labelled log files (S1, S2): CSV with a header, or Parquet.

CSV options keep quotes, embedded newlines, backslashes and leading or
trailing blanks intact through a write / read round trip.  The schema is
explicit; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.schemas import LABELLED_LOG

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "mode": "PERMISSIVE",
}


# Where a line that does not parse is kept.
BAD_LINE = "bad_line"


def read_labelled_logs(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True,
                       header: bool = True, keep_bad: bool = False) -> DataFrame:
    """S1.  Records with a missing message cannot be trained on; callers
    filter them (see ``trainable``).

    ``multi_line=False``: one record a line, so that a file is split by bytes
    among tasks; a file of records with line ends inside needs one task.
    ``keep_bad`` adds ``BAD_LINE``: the text of a line with too few or too many
    fields, null for good ones (see ``split_bad``).
    """
    if fmt == "parquet":
        return spark.read.schema(LABELLED_LOG).parquet(path)
    options = {**CSV_OPTIONS, "multiLine": str(multi_line).lower(), "header": str(header).lower()}
    schema = LABELLED_LOG
    if keep_bad:
        schema = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
        options["columnNameOfCorruptRecord"] = BAD_LINE
    return spark.read.schema(schema).options(**options).csv(path)


def split_bad(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, lines to quarantine) of a read with ``keep_bad``."""
    # Spark judges a line by the columns that are asked for, so both filters
    # name all of them, whatever is selected afterwards.
    other = F.length(F.concat_ws("", *LABELLED_LOG.names)) >= 0
    bad = F.col(BAD_LINE).isNotNull()
    return logs.where(~bad & other).drop(BAD_LINE), logs.where(bad & other).select(BAD_LINE)


def csv_line() -> Column:
    """The labelled columns as one CSV line; its values have no line ends."""
    fields = [F.concat(F.lit('"'), F.replace(F.col(f.name), F.lit('"'), F.lit('""')), F.lit('"')) for f in LABELLED_LOG.fields]
    return F.concat_ws(",", *fields)


def write_labelled_logs(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Overwrite ``path`` with the five labelled columns."""
    out = df.select(*[f.name for f in LABELLED_LOG.fields])
    w = out.write.mode("overwrite")
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.options(**CSV_OPTIONS).csv(path)


def trainable(df: DataFrame) -> DataFrame:
    """Rows a classifier can learn from: message and label present."""
    return df.where(F.col("message").isNotNull() & F.col("true_label").isNotNull())
