"""WARC archives: a writer that stores equal payloads once, and a sequential
reader (operator 13).

Writing.  Payload digests are grouped in Spark; of equal payloads the row with
the smallest page id becomes a ``response`` record, the others ``revisit``
records that refer to it.  A record is one gzip member.  Spark's text sink
commits the members as files: it ends every row with a separator, here the
zero byte that ends each member anyway (the top byte of its length; a member of
16 MB or more is followed by an empty one for that), so the files are plain
``.warc.gz`` bytes on any file system that Spark reaches, and a lost task
leaves nothing behind.

Reading.  An archive is read from front to back: bytes are decompressed a step
at a time, the header names the length of the block, the block is taken by that
length and checked against its digests, and the member must end behind it.  A
cut, damaged or wrongly framed archive raises ``WarcError``.

Bounds: an archive is written by one task and read by one task, which holds
its compressed bytes and one record.  The texts cross the network once, to meet
their decisions; no group of copies is gathered (digests are counted by partial
aggregation, and payloads with more than a thousandth of the rows are joined by
broadcast, of which there are less than a thousand).

Defined cases: null html is the empty payload, and empty payloads are equal; a
null page id is larger than any other and reads back as null; of rows that
share the smallest id one is the response; a null URL is left out of the
record; an empty table writes no archive and reads as no rows; other columns
are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import join_unique, keyed_rows, new_path, saved, text_of

# Date of the records: the tables name no time of capture.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP, BATCH_BYTES = 1 << 16, 1 << 24
PRINTABLE = "".join(map(chr, range(33, 127)))
LAST_ID = (1 << 63) - 1


class WarcError(ValueError):
    """An archive that is cut, damaged or wrongly framed."""


class Record(NamedTuple):
    header: dict[str, str]
    block: bytes


def digest_of(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records -------------------------------------------------------------------

def member(header: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = [*header, ("WARC-Block-Digest", "sha1:" + digest_of(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def record_name(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{row}>"


def page_of(name: str) -> int | None:
    """The page id in a record's name."""
    page = name.strip("<>").split(":")[2]
    return None if page == "none" else int(page)


def page_record(page_id: int | None, row: int, url: str | None, payload: bytes,
                refers_to: str | None = None) -> bytes:
    """A page as response, or as revisit of the record ``refers_to``, which
    keeps the HTTP header (and with it the length) but not the payload."""
    header = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_name(page_id, row)),
              ("WARC-Date", DATE)]
    if url is not None:
        header.append(("WARC-Target-URI", quote(url, safe=PRINTABLE)))
    header += [("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", "sha1:" + digest_of(payload))]
    if refers_to:
        header += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return member(header, http.encode() if refers_to else http.encode() + payload)


class _Members:
    """Bytes of gzip members that arrive in pieces, one member at a time."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.rest = iter(pieces), b""
        self.z, self.held = None, bytearray()

    def open(self) -> bool:
        """Start the next member; False at the end of the archive."""
        self.rest = self.rest or next(self.pieces, b"")
        if not self.rest:
            return False
        self.z, self.held = zlib.decompressobj(31), bytearray()
        return True

    def fill(self) -> bool:
        """Decompress a step more; False at the member's end."""
        while not self.z.eof:
            data, self.rest = self.z.unconsumed_tail or self.rest or next(self.pieces, b""), b""
            if not data:
                raise WarcError("the archive ends inside a record")
            try:
                out = self.z.decompress(data, STEP)
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            if self.z.eof:
                self.rest = self.z.unused_data
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.fill():
                raise WarcError("a record's header does not end")
        out = bytes(self.held[:at])
        del self.held[:at + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self.fill():
                raise WarcError("a record is shorter than its Content-Length")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def fields_of(head: str) -> dict[str, str]:
    """Header lines behind the first, by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split("\r\n")[1:])}


def records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive in order, framed by their lengths and checked
    against their block digests."""
    source = _Members(pieces)
    while source.open():
        if not source.fill():
            continue  # an empty member
        head = source.until(b"\r\n\r\n").decode()
        if not head.startswith("WARC/"):
            raise WarcError("a member does not begin with a WARC header")
        header = fields_of(head)
        if not header.get("content-length", "").isdigit():
            raise WarcError("a record without Content-Length")
        block = source.take(int(header["content-length"]))
        if source.take(4) != b"\r\n\r\n" or source.fill() or source.held:
            raise WarcError("a record is longer than its Content-Length")
        check(header.get("warc-block-digest"), block, "block")
        yield Record(header, block)


def check(stated: str | None, data: bytes, what: str) -> None:
    """Digests of other kinds than SHA-1 are not checked."""
    if stated and stated.startswith("sha1:") and stated[5:] != digest_of(data):
        raise WarcError(f"the {what} digest differs")


def payload_of(record: Record) -> tuple[int, str, bytes | None]:
    """``(bytes, digest, payload)`` of the full payload; a revisit states the
    first two and has no payload."""
    header, block = record
    stated = header.get("warc-payload-digest")
    if not header.get("content-type", "").startswith("application/http"):
        check(stated, block, "payload")
        return len(block), digest_of(block), block
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError("an HTTP header does not end")
    length = fields_of(http.decode("latin-1")).get("content-length", "")
    if header.get("warc-type") == "revisit":
        if not length.isdigit() or not stated:
            raise WarcError("a revisit without its payload's length or digest")
        return int(length), stated.removeprefix("sha1:"), None
    if length and length != str(len(payload)):
        raise WarcError("a payload of another length than its HTTP header says")
    check(stated, payload, "payload")
    return len(payload), digest_of(payload), payload


# --- Spark ------------------------------------------------------------------------

def decisions(rows: DataFrame, id_column: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """``row_file, row_no, page_id, rid, refers_to`` of every row of
    ``keyed_rows``; ``refers_to``: the response's record name, null for
    responses.  Payloads of fewer than ``min_bytes`` bytes are responses."""
    payload = text_of(F.col(f"doc.`{html}`"))
    plan = saved(rows.select("row_file", "row_no", F.col(f"doc.`{id_column}`").cast("long").alias("page_id"),
                             F.monotonically_increasing_id().alias("rid"), F.sha2(payload, 256).alias("digest"),
                             F.octet_length(payload).alias("size")), "payloads")
    order = F.coalesce("page_id", F.lit(LAST_ID))
    groups = plan.filter(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first_page"), F.min_by("rid", order).alias("first_rid"))
    joined = join_unique(plan, saved(groups.filter("n > 1"), "copies"), "digest")
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first_page").cast("string"), F.lit("none")), F.lit(":"),
                    F.col("first_rid").cast("string"), F.lit(">"))
    revisit = (F.col("first_rid") != F.col("rid")) & (F.col("size") >= min_bytes)
    return joined.select("row_file", "row_no", "page_id", "rid", F.when(revisit, name).alias("refers_to"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members without their last byte, which the sink writes."""
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})

    out, size = [], 0
    empty = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
    for batch in batches:
        page_ids, rids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
        for page_id, rid, url, payload, refers_to in zip(page_ids, rids, urls, batch.column(3), refers):
            data = page_record(page_id, rid, url, payload.as_buffer().to_pybytes(), refers_to)
            if data[-1]:
                data += empty
            out.append(data[:-1])
            size += len(data)
            if size > BATCH_BYTES:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 0) -> None:
    """Write every row of ``pages`` as a record of the archives at ``path``."""
    rows = keyed_rows(pages)
    decided = decisions(rows, id_column, html, min_bytes).hint("shuffle_hash")
    texts = rows.select("row_file", "row_no", F.col(f"doc.`{url}`").cast("string").alias("url"),
                        text_of(F.col(f"doc.`{html}`")).alias("payload"))
    whole = texts.join(decided, ["row_file", "row_no"]).select("page_id", "rid", "url", "payload", "refers_to")
    out = whole.mapInArrow(_members, "member binary")
    out.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


SCHEMA = ("record_type string, record_name string, target_uri string, payload_bytes long, payload_digest string, "
          "refers_to string, payload binary")


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        out, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                for r in records(data[k:k + STEP] for k in range(0, len(data), STEP)):
                    size, digest, payload = payload_of(r)
                    out.append((r.header.get("warc-type"), r.header.get("warc-record-id"), r.header.get("warc-target-uri"),
                                size, digest, r.header.get("warc-refers-to"), payload if with_payload else None))
                    held += 500 + (size if with_payload else 0)
                    if held > BATCH_BYTES:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()
    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives at ``path`` (files named
    ``part-*``), as in ``SCHEMA``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), SCHEMA)


def dangling(found: DataFrame) -> DataFrame:
    """Revisits whose response is missing or has another payload; none in
    whole archives."""
    responses = found.filter("record_type = 'response'").select(
        F.col("record_name").alias("refers_to"), "payload_bytes", "payload_digest")
    return found.filter("record_type = 'revisit'").join(responses, ["refers_to", "payload_bytes", "payload_digest"], "left_anti")


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of
    every row, from archives written for it."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    found = read_archives(pages.sparkSession, path, with_payload=False)
    page = lambda c: F.split_part(c, F.lit(":"), F.lit(3)).try_cast("long")
    return found.select(page(F.col("record_name")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        page(F.col("refers_to")).alias("refers_to"))
