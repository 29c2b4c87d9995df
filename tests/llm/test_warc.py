"""WARC archives: round trip, framing faults, and the query by brute force."""

import base64
import gzip
import hashlib
import zlib
from collections import Counter

import pytest

from logsift.llm import warc
from logsift.llm.common import new_path
from logsift.llm.queries import op13_warc
from tests.conftest import SF_SMALL


def brute(rows, min_bytes=0):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        page_id, payload = rows[i][0], (rows[i][1] or "").encode()
        kind, ref = "response", None
        if len(payload) >= min_bytes:
            if payload in first:
                kind, ref = "revisit", first[payload]
            else:
                first[payload] = page_id
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, ref))
    return Counter(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2) for r in rows],
                                 "page_id long, html string, url string, rid long, row_file string, n long")


def as_counter(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


ODD = [(5, "same", "http://a/b c\r\nX: y"), (3, "same", None), (9, "same", "http://ü.example/"), (None, "same", "x"),
       (7, None, "u"), (8, "", "u"), (None, None, None), (4, "é€\U0001f600\0\r\n\r\n", "u"), (-2, "x" * 300_000, "u"),
       (4, "twice", "u"), (4, "twice", "u"), (6, "twice", "u")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    got = as_counter(warc.archived_pages(table(spark, ODD), min_bytes=least))
    assert got == brute([r[:2] for r in ODD], least)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html").collect()]
    assert as_counter(op13_warc(spark, SF_SMALL)) == brute(rows)


def test_many_copies_of_one_page(spark):
    rows = [(i, "hot" if i % 3 else f"own {i}", "u") for i in range(3000)]
    assert as_counter(warc.archived_pages(table(spark, rows))) == brute([r[:2] for r in rows])


def test_empty_table(spark):
    assert warc.archived_pages(table(spark, ODD).limit(0)).count() == 0


def test_archives_are_plain_gzip_members(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(table(spark, ODD), path)
    found = warc.read_archives(spark, path)
    payloads = {r.record_name: bytes(r.payload) for r in found.filter("record_type = 'response'").collect()}
    assert Counter(p.decode() for p in payloads.values()) == Counter({r[1] or "" for r in ODD})
    assert warc.dangling(found).count() == 0
    whole = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    text = gzip.decompress(whole)
    assert text.count(b"WARC/1.1\r\n") == len(ODD) and b"\r\nX: y\r\n" not in text
    missing = found.filter("record_type != 'response' OR payload_bytes != 4")
    assert warc.dangling(missing).count() == 3


def one(payload=b"body", refers=None):
    return warc.page_record(1, 0, "http://a/", payload, refers)


def names(data, step=7):
    return [r.header["warc-record-id"] for r in warc.records(data[k:k + step] for k in range(0, len(data), step))]


def test_reader_takes_any_pieces_and_empty_members():
    data = one() + zlib.compressobj(6, zlib.DEFLATED, 31).flush() + one(b"x" * 200_000) + one(b"", "<urn:page:1:0>")
    assert [len(names(data, s)) for s in (1, 13, 1 << 20)] == [3, 3, 3]
    assert list(warc.records(iter(()))) == []


def remade(change):
    return gzip.compress(change(gzip.decompress(one())))


@pytest.mark.parametrize("data", [
    one()[:-9], one() + b"junk", one() + one()[:20], gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"),
    remade(lambda b: b.replace(b"body", b"bodx")), remade(lambda b: b + b"more"), remade(lambda b: b[:-6]),
    remade(lambda b: b.replace(b"\r\nContent-Length: ", b"\r\nContent-Size: ")),
    remade(lambda b: b.replace(b"\r\n\r\n", b"\r\n")), gzip.compress(b"WARC/1.1\r\nContent-Length: 900\r\n\r\nshort\r\n\r\n")])
def test_faulty_archives_raise(data):
    with pytest.raises(warc.WarcError):
        names(data)


def test_payload_digest_is_verified():
    record = next(warc.records([one()]))
    wrong = record._replace(block=record.block.replace(b"body", b"bodx"))
    with pytest.raises(warc.WarcError):
        warc.payload_of(wrong)
    assert warc.payload_of(record) == (4, warc.digest_of(b"body"), b"body")
    assert warc.payload_of(next(warc.records([one(b"body", "<urn:page:1:0>")])))[2] is None


def test_large_member_ends_with_a_zero_byte():
    import os

    import pyarrow as pa
    payload = os.urandom(17 << 20)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["u"]), pa.array([payload], pa.binary()),
                                        pa.array([None], pa.string())], list("abcde"))
    data = b"".join(m.as_py() + b"\0" for b in warc._members(iter([batch])) for m in b.column(0))
    got = list(warc.records([data]))
    assert len(got) == 1 and warc.payload_of(got[0])[2] == payload
