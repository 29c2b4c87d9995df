"""Token ids in files of a static range asymmetric numeral system (operator 6).

Texts are dealt by id ranges and sorted, tokenized once, and written as rows
of ``(part, seq, start, payload)``.  A payload is a group of blocks that share
one frequency table, counted over all ids of the group.  A block holds whole
documents; its ids are cut into segments, and a segment is encoded by
interleaved lanes.  Every segment starts from a checkpoint (lane states, place
in the word stream) and carries a checksum, so segments decode independently:
the decoder runs all segments of a block in step.

State: 64 bits, renormalised by 32-bit words, frequencies summing to 2^20.

Bounds: a group is closed at ``GROUP_IDS`` ids, or after the document that
passes it; the offsets of parts are one row per file part.

Defined cases: a null or empty text has only the end id; null ids come first;
rows of equal id are kept side by side; an empty table writes no group.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.llm.common import Recent, new_path

GROUP_IDS, BLOCK_IDS, SEGMENT_IDS, LANES = 1 << 22, 1 << 20, 1 << 16, 128
SCALE = 20
LOW = np.uint64(1 << 31)
MAGIC = b"RANS1\0\0\0"
MEMO = 350_000
U20, U32, U43 = np.uint64(SCALE), np.uint64(32), np.uint64(63 - SCALE)
SLOTS = np.uint64((1 << SCALE) - 1)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum 2^20, at least 1 for every id that occurs."""
    used = counts > 0
    spare = (1 << SCALE) - int(used.sum())
    scaled = np.where(used, 1 + counts.astype(np.int64) * spare // max(1, int(counts.sum())), 0)
    scaled[int(counts.argmax())] += (1 << SCALE) - int(scaled.sum())
    return scaled.astype(np.uint64)


class Table:
    """Frequencies, their running sums, and the id of every slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.common = int(freq.argmax())
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One block: header, checkpoints, checksums, word stream."""
    n = len(ids)
    segments = max(1, -(-n // SEGMENT_IDS))
    rows = -(-n // (segments * LANES))
    grid = np.full(segments * rows * LANES, table.common, dtype=np.int64)
    grid[:n] = ids
    grid = grid.reshape(segments, rows, LANES)
    state = np.full((segments, LANES), LOW, dtype=np.uint64)
    words = np.empty((segments, rows, LANES), dtype=np.uint32)
    sent = np.empty((segments, rows, LANES), dtype=bool)
    for r in range(rows - 1, -1, -1):
        symbol = grid[:, r]
        f = table.freq[symbol]
        full = state >= (f << U43)
        words[:, r], sent[:, r] = state.astype(np.uint32), full
        state = np.where(full, state >> U32, state)
        q = state // f
        state = (q << U20) + (state - q * f) + table.cum[symbol]
    per = sent.reshape(segments, -1)
    stream = words.reshape(segments, -1)[per]
    at = np.concatenate([[0], np.cumsum(per.sum(axis=1))[:-1]]).astype("<u4")
    flat = grid.reshape(segments, -1).astype("<u4")
    sums = np.array([zlib.crc32(flat[s]) for s in range(segments)], dtype="<u4")
    head = struct.pack("<4I", n, segments, rows, len(stream))
    return b"".join([head, at.tobytes(), sums.tobytes(), state.astype("<u8").tobytes(),
                     stream.astype("<u4").tobytes()])


def decode_block(data: memoryview, table: Table) -> tuple[np.ndarray, int]:
    """``(ids, bytes read)``; raises when a lane or a checksum is wrong."""
    n, segments, rows, n_words = struct.unpack_from("<4I", data, 0)
    place = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(data, kind, count, place)
        place += out.nbytes
        return out

    pos, sums = take("<u4", segments).astype(np.int64), take("<u4", segments)
    state = take("<u8", segments * LANES).reshape(segments, LANES).astype(np.uint64)
    stream = np.append(take("<u4", n_words), np.uint32(0)).astype(np.uint64)
    grid = np.empty((segments, rows, LANES), dtype=np.uint32)
    for r in range(rows):
        slot = state & SLOTS
        symbol = table.slots[slot.astype(np.int64)]
        grid[:, r] = symbol
        state = table.freq[symbol] * (state >> U20) + slot - table.cum[symbol]
        low = state < LOW
        nth = np.cumsum(low, axis=1)
        index = np.minimum(pos[:, None] + nth - 1, n_words)
        state = np.where(low, (state << U32) | stream[index], state)
        pos += nth[:, -1]
    if (state != LOW).any():
        raise ValueError("a lane does not end where it began")
    flat = grid.reshape(segments, -1)
    for s in range(segments):
        if zlib.crc32(flat[s].astype("<u4")) != sums[s]:
            raise ValueError(f"checksum of segment {s} differs")
    return flat.reshape(-1)[:n], place


def pack_group(doc_ids: list[int | None], lengths: list[int], blocks: list[np.ndarray], vocabulary: int) -> bytes:
    """A group's payload: directory of documents, table, blocks."""
    counts = np.zeros(vocabulary, dtype=np.int64)
    for b in blocks:
        counts += np.bincount(b, minlength=vocabulary)
    table = Table(frequencies(counts))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    directory = b"".join([known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                          np.array(lengths, "<u4").tobytes()])
    packed = zlib.compress(table.freq.astype("<u4").tobytes(), 6)
    head = MAGIC + struct.pack("<4I", len(doc_ids), len(blocks), vocabulary, len(packed))
    return b"".join([head, directory, packed, *(encode_block(b, table) for b in blocks)])


def unpack_group(payload: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """``(doc ids, lengths, decoded blocks)``."""
    if payload[:8] != MAGIC:
        raise ValueError("not a group of token blocks")
    n_docs, n_blocks, vocabulary, packed = struct.unpack_from("<4I", payload, 8)
    at = 24
    known = np.frombuffer(payload, np.uint8, n_docs, at)
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at + n_docs)
    lengths = np.frombuffer(payload, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    table = Table(np.frombuffer(zlib.decompress(payload[at:at + packed]), "<u4").astype(np.uint64))

    def blocks() -> Iterator[np.ndarray]:
        place, view = at + packed, memoryview(payload)
        for _ in range(n_blocks):
            ids, read = decode_block(view[place:], table)
            place += read
            yield ids

    return [int(d) if k else None for d, k in zip(doc_ids, known)], lengths, blocks()


class WordIds:
    """Ids of words as little-endian 32-bit integers, by the tokenizers
    library.  The tokenizer drops white space and
    never joins characters across it, so a text's ids are its words' ids.

    Words of Latin letters go through the library's merge model piece by
    piece (its splitter and normaliser do nothing else to them), all others
    through its whole encoder.
    """

    # Fixed value: the split pattern of the tokenizer.
    _pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
    _other = re.compile("<\\||[ɐ-\U0010ffff]").search

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.words, self.parts = Recent(self._word, MEMO), Recent(self._piece, MEMO // 2)
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(kept)]
        self.shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.size = self.library.get_vocab_size(with_added_tokens=True)

    def _piece(self, piece: str) -> bytes:
        # Printable ASCII stands for itself in the vocabulary.
        shown = piece if piece.isascii() and piece.isprintable() else "".join(map(self.shown.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters are one piece
            return self.parts[word.lower().decode()]
        text = word.decode()
        if self._other(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.parts.__getitem__, WordIds._pieces(text.lower())))

    def text_ids(self, text: str | None) -> bytes:
        # bytes.split() splits at the six ASCII white spaces.
        return b"".join(map(self.words.__getitem__, text.encode().split())) if text else b""


_WORDS: dict[str, WordIds] = {}


def _words(name: str, spec) -> WordIds:
    """This worker's word ids of the tokenizer with that checksum."""
    if name not in _WORDS:
        _WORDS.clear()
        _WORDS[name] = WordIds(spec.value)
    return _WORDS[name]


def _group_writer(name: str, spec, end_id: int):
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        words = _words(name, spec)
        doc_ids, lengths, blocks, pending, size, total = [], [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal seq, start, total
            payload = pack_group(doc_ids, lengths, blocks, words.size)
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "start": pa.array([start], pa.int64()), "n_ids": pa.array([total], pa.int64()),
                "payload": pa.array([payload], pa.binary())})
            seq, start, total = seq + 1, start + total, 0
            doc_ids.clear(), lengths.clear(), blocks.clear()
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.text_ids(text.as_py()) + end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                pending.append(ids)
                size += len(ids) // 4
                if size >= BLOCK_IDS:
                    blocks.append(np.frombuffer(b"".join(pending), "<u4"))
                    total, pending, size = total + size, [], 0
                    if total >= GROUP_IDS:
                        yield close()
        if pending:
            blocks.append(np.frombuffer(b"".join(pending), "<u4"))
            total += size
        if blocks:
            yield close()

    return write


GROUP = "part int, seq int, start long, n_ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, text: str = "text") -> None:
    """Write the ids of all texts, in ascending ``doc_id`` order, to ``path``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer)
    name = hashlib.sha256(tokenizer.encode()).hexdigest()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(_group_writer(name, spec, end_id), GROUP).write.parquet(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups with ``first``: the number of ids before them in the whole."""
    groups = spark.read.schema(GROUP).parquet(path)
    parts = groups.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return groups.join(F.broadcast(parts), "part").select((F.col("before") + F.col("start")).alias("first"), "payload")


def _each_document(payload: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """``(doc_id, ids before it in the group, ids)``."""
    doc_ids, lengths, blocks = unpack_group(payload)
    number = start = 0
    for ids in blocks:
        at = 0
        while at < len(ids):
            n = int(lengths[number])
            yield doc_ids[number], start, ids[at:at + n]
            number, at, start = number + 1, at + n, start + n


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = [(d, first + s, len(ids), ids.astype("<u4").tobytes()) for d, s, ids in _each_document(payload.as_py())]
            for i in range(0, len(rows), 2000):
                part = rows[i:i + 2000]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([r[0] for r in part], pa.int64()), "start": pa.array([r[1] for r in part], pa.int64()),
                    "n_tokens": pa.array([r[2] for r in part], pa.int64()), "ids": pa.array([r[3] for r in part], pa.binary())})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of
    every document in the files."""
    return read_groups(spark, path).mapInArrow(_read_documents, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, text: str = "text") -> DataFrame:
    """Write the ids to the shared folder and read every document back:
    ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, text)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
