"""Tables of micro-batches with a commit list.

A batch writes its rows into a folder of its own, partitioned by date, and then
adds one empty file to the list whose name says which folder holds the batch.
Creating that file is the commit: a reader lists the names and reads only the
folders they call valid, so it sees every batch once and whole, or not at all.

* A replayed batch writes a new folder and a later entry, which replaces the
  earlier one.
* A crash before the commit leaves a folder that no entry names.
* ``compact`` rewrites the batches so far into few files and adds one entry
  that stands for all of them; a batch that is replayed after that is in the
  table already and is left out.
* ``clean`` deletes folders that no longer count, when no reader needs them.

One stream writes a table at a time, as a streaming query does.
"""

from __future__ import annotations

import math
import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of a compacted file.
FILE_BYTES = 128 << 20
_ENTRY = re.compile(r"(batch|upto)-(\d+)\.(\d+)\.([0-9a-f]{32})$")


class Entry(NamedTuple):
    kind: str
    batch: int
    turn: int
    folder: str


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def entries(self) -> list[Entry]:
        found = filter(None, map(_ENTRY.match, self._names("commits")))
        return [Entry(m[1], int(m[2]), int(m[3]), m[4]) for m in found]

    def valid(self) -> list[Entry]:
        """The entries that count: the latest compaction, and the latest turn
        of every batch behind it."""
        entries = self.entries()
        base = max((e for e in entries if e.kind == "upto"), key=lambda e: (e.batch, e.turn), default=None)
        latest: dict[int, Entry] = {}
        for e in sorted((e for e in entries if e.kind == "batch"), key=lambda e: e.turn):
            if base is None or e.batch > base.batch:
                latest[e.batch] = e
        return ([base] if base else []) + [latest[b] for b in sorted(latest)]

    def _write(self, df: DataFrame, date: Column) -> str:
        folder = uuid.uuid4().hex
        columns = [f.name for f in self.schema.fields]
        df.select(*columns, date.cast("date").alias("date")).write.partitionBy("date").parquet(f"{self.path}/data/folder={folder}")
        return folder

    def _commit(self, kind: str, batch: int, folder: str) -> None:
        turn = 1 + max((e.turn for e in self.entries() if e.kind == kind and e.batch == batch), default=0)
        if not self._fs.createNewFile(self._at(f"commits/{kind}-{batch:020d}.{turn}.{folder}")):
            raise RuntimeError(f"batch {batch} of {self.path} was committed by another writer")

    def write(self, df: DataFrame, batch: int, date: Column) -> bool:
        """Replace batch ``batch`` by ``df``; False where a compaction holds
        the batch already."""
        if any(e.kind == "upto" and e.batch >= batch for e in self.entries()):
            return False
        self._commit("batch", batch, self._write(df, date))
        return True

    def _read(self, entries: list[Entry]) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("date", T.DateType()), T.StructField("folder", T.StringType())])
        if not entries:
            return self.spark.createDataFrame([], full).drop("folder")
        paths = [f"{self.path}/data/folder={e.folder}" for e in entries]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths).drop("folder")

    def read(self, before: int | None = None) -> DataFrame:
        """All committed batches, or those below ``before``; filters on
        ``date`` prune folders."""
        valid = self.valid()
        if before is not None and any(e.kind == "upto" and e.batch >= before for e in valid):
            raise ValueError(f"batches below {before} are compacted with later ones")
        return self._read([e for e in valid if before is None or e.batch < before])

    def compact(self, upto: int | None = None, file_bytes: int = FILE_BYTES) -> None:
        """Rewrite the batches up to ``upto`` (all) into files of about
        ``file_bytes``."""
        entries = [e for e in self.valid() if upto is None or e.batch <= upto]
        if len(entries) < 2:
            return
        size = sum(self._fs.getContentSummary(self._at(f"data/folder={e.folder}")).getLength() for e in entries)
        few = self._read(entries).repartition(max(1, math.ceil(size / file_bytes)))
        self._commit("upto", max(e.batch for e in entries), self._write(few, F.col("date")))

    def clean(self) -> int:
        """Delete the folders of replaced and compacted batches, and of tries
        that were never committed; not while the stream writes."""
        keep = {f"folder={e.folder}" for e in self.valid()}
        old = [n for n in self._names("data") if n.startswith("folder=") and n not in keep]
        for name in old:
            self._fs.delete(self._at(f"data/{name}"), True)
        return len(old)
