"""Alignment of two tokenizers by inverted pair bitmaps (operator 11).

A text is encoded by both tokenizers; where tokens of both end at the same
byte, the text is cut into groups, and every token of one side is linked to
every token of the other side in its group.  For each pair of ids the documents
that hold it linked are a compressed bitmap: documents are numbered in blocks of
2^16, and a block's container is a sorted list of 16-bit offsets, or a bitmap
where that is shorter.  How often a document links the pair stands in
multiplicity planes: plane k + 1 holds the documents with bit k set in that
number less one.  A pair's bitmap is the union of its containers, and its count
the sum of their cardinalities; link counts are the planes' cardinalities by
weight.  For the scores of documents the postings meet their pair's count and
return, block by block, to the documents they hold.

Bounds: a block ends at ``BLOCK_DOCS`` documents or ``BLOCK_LINKS`` distinct
pairs of documents (with the document that passes it), so one task holds one
block.  A pair has one row for each block and plane, so no pair and no id
gathers rows of documents in one task; counts and the best count of an id are
partial aggregates.  Texts never cross the network.

Defined cases: a null or empty text, and one whose tokens do not give back
space + text, has no tokens and zeros; ids of documents may be null or repeated
(rows are numbered by the engine); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import saved

BLOCK_DOCS, BLOCK_LINKS = 1 << 16, 1 << 22
TEXT_BATCH = 64
# Groups of more links than this are linked by distinct ids and their counts.
WIDE_GROUP = 4096
# Containers of more offsets than this are bitmaps.
SPARSE = 4096
BLOCK_BITS = 24

# Beyond Latin the library's own splitter decides: Unicode tables may differ.
_beyond_latin = re.compile("[ɐ-\U0010ffff]").search


def letters_of_bytes() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes for bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """Ids of texts, and the length and bytes of every id."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.size = max(bytes_of) + 1
        self.bytes_of = [bytes_of.get(i, b"") for i in range(self.size)]
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class ByteSide(Side):
    """A byte-level vocabulary over space + text.  Plain texts go through its
    ranks, all others through the library."""

    def __init__(self, spec: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        byte = letters_of_bytes()
        entries = {i: bytes(byte[c] for c in t) for t, i in self.library.get_vocab(with_added_tokens=False).items()
                   if all(c in byte for c in t)}
        super().__init__(entries)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.encode().splitlines())}
        if any(entries.get(i) != b for b, i in table.items()):
            raise ValueError("the ranks belong to another vocabulary")
        self.ranks = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        other = [i for i, t in enumerate(texts) if _beyond_latin(t)]
        found = self.library.encode_batch_fast([" " + texts[i] for i in other], add_special_tokens=False) if other else []
        by_library = {i: e.ids for i, e in zip(other, found)}
        return [by_library[i] if i in by_library else self.ranks.encode_ordinary(" " + t) for i, t in enumerate(texts)]


class PieceSide(Side):
    """A sentence piece model, which adds the space itself."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        entries = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            entries[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        super().__init__(entries)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligned:
    """Groups and links of one text; without tokens all is empty."""

    def __init__(self, a_ids: list[int], b_ids: list[int], a: Side, b: Side, marks: list[str]):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.text = len(a_ids), len(b_ids), 0, 0, ""
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        if not a_ids:
            return
        x, y = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        ends_a, ends_b = np.cumsum(a.width[x]), np.cumsum(b.width[y])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        links = in_a * in_b
        self.n_groups, self.n_links = len(cuts), int(links.sum())
        self.text = group_text(x, y, group_a, group_b, marks, a.size)

        # Every token of one side meets those of the other in its group.
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        narrow = links[group_a] <= WIDE_GROUP
        mine, times = x[narrow], in_b[group_a[narrow]]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = y[np.repeat(first_b[group_a[narrow]], times) + place]
        codes, counts = [np.repeat(mine, times) * b.size + other], [np.ones(len(other), np.int64)]
        for g in np.flatnonzero(links > WIDE_GROUP).tolist():
            u, nu = np.unique(x[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
            v, nv = np.unique(y[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
            codes.append((u[:, None] * b.size + v).ravel())
            counts.append((nu[:, None] * nv).ravel())
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        code, weight = code[order], np.concatenate(counts)[order]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        self.pairs, self.times = code[start], np.add.reduceat(weight, start)


def group_text(x: np.ndarray, y: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, marks: list[str], a_size: int) -> str:
    """``a1,a2|b1;a3|b2,b3``: groups in order, each with both sides' ids.
    ``marks``: every id of both sides followed by each of the three signs."""
    place = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(place, kind="stable")
    place, word = place[order], np.concatenate([x, y + a_size])[order]
    sign = np.where(place[1:] == place[:-1], 0, np.where(place[1:] & 1, 1, 2))
    word[:-1] += sign * (len(marks) // 3)
    return "".join(map(marks.__getitem__, word.tolist()))[:-1]


class Aligner:
    def __init__(self, byte_spec: str, ranks: str, piece_model: bytes):
        self.a, self.b = ByteSide(byte_spec, ranks), PieceSide(piece_model)
        ids = [str(i) for side in (self.a, self.b) for i in range(side.size)]
        self.marks = [i + sign for sign in ",|;" for i in ids]

    def align(self, texts: Iterable[str | None]) -> Iterator[Aligned]:
        texts = [t or "" for t in texts]
        for t, x, y in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            whole = (" " + t).encode()
            if not t or self.a.joined(x) != whole or self.b.joined(y) != whole:
                x, y = [], []
            yield Aligned(x, y, self.a, self.b, self.marks)


# --- containers --------------------------------------------------------------------

def dense(offsets: np.ndarray) -> bytes:
    bits = np.zeros(BLOCK_DOCS, np.uint8)
    bits[offsets] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def offsets_of(container: bytes, is_dense: bool) -> np.ndarray:
    if is_dense:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little"))
    return np.frombuffer(container, "<u2")


def containers(pair: np.ndarray, offset: np.ndarray, plane: int, block: int) -> pa.Table:
    """Rows of one plane: ``pair`` is sorted, ``offset`` ascends within it."""
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(pair)))
    data = offset.astype("<u2")
    lists = pa.BinaryArray.from_buffers(pa.large_binary(), len(n), [
        None, pa.py_buffer(2 * np.append(start, len(pair)).astype(np.int64)), pa.py_buffer(data)])
    lists, big = lists.cast(pa.binary()), n > SPARSE
    if big.any():
        whole = lists.to_pylist()
        for i in np.flatnonzero(big).tolist():
            whole[i] = dense(data[start[i]:start[i] + n[i]])
        lists = pa.array(whole, pa.binary())
    return pa.table({"block": np.full(len(n), block), "pair": pair[start], "plane": pa.array(np.full(len(n), plane), pa.int32()),
                     "n": n.astype(np.int64), "dense": big, "docs": lists})


def postings(pair: np.ndarray, offset: np.ndarray, times: np.ndarray, block: int) -> Iterator[pa.Table]:
    """A block's containers: of the documents, and of each multiplicity plane."""
    order = np.lexsort((offset, pair))
    pair, offset, more = pair[order], offset[order], times[order] - 1
    yield containers(pair, offset, 0, block)
    for k in range(int(more.max(initial=0)).bit_length()):
        on = (more >> k & 1).astype(bool)
        yield containers(pair[on], offset[on], k + 1, block)


# --- Spark ----------------------------------------------------------------------------

DOCS = pa.schema([("block", pa.int64()), ("offset", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                  ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
POSTINGS = pa.schema([("pair", pa.int64()), ("plane", pa.int32()), ("n", pa.int64()), ("dense", pa.bool_()), ("docs", pa.binary())])
SCHEMA = ("block long, offset int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pair long, plane int, n long, dense boolean, docs binary")

_LOADED: dict[str, Aligner] = {}


def _aligner(key: str, files) -> Aligner:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(*files.value)
    return _LOADED[key]


def _whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """With all columns of ``SCHEMA``."""
    fields = list(DOCS) + list(POSTINGS)
    none = lambda kind: pa.nulls(t.num_rows, kind)
    yield from pa.table([t[f.name].cast(f.type) if f.name in t.column_names else none(f.type) for f in fields],
                        [f.name for f in fields]).to_batches()


def _index(key: str, files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, made = _aligner(key, files), TaskContext.get().partitionId() << BLOCK_BITS, 0
        rows: list[tuple] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [list(c) for c in zip(*rows)]
            yield from _whole(pa.table([pa.array(c, f.type) for c, f in zip(columns, DOCS)], schema=DOCS))
            many = np.array([len(p) for p, _ in parts])
            pair, times = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            for t in postings(pair, np.repeat(np.arange(len(parts)), many), times, block + made):
                if t.num_rows:
                    yield from _whole(t)

        for batch in batches:
            for k in range(0, batch.num_rows, TEXT_BATCH):
                some = batch.slice(k, TEXT_BATCH)
                for doc_id, x in zip(some.column(0).to_pylist(), aligner.align(some.column(1).to_pylist())):
                    digest = hashlib.sha256(x.text.encode()).hexdigest() if x.text else ""
                    rows.append((block + made, len(rows), doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, digest))
                    parts.append((x.pairs, x.times))
                    size += len(x.pairs)
                    if len(rows) == BLOCK_DOCS or size > BLOCK_LINKS:
                        yield from flush()
                        rows, parts, size, made = [], [], 0, made + 1
        if rows:
            yield from flush()
    return run


class Index:
    """``docs`` (one row a document, with its place ``block, offset``) and
    ``postings`` (``block, pair, plane, n, dense, docs``) of a corpus.  A pair
    is its A id times ``b_size`` plus its B id."""

    def __init__(self, table: DataFrame, b_size: int):
        self.b_size = b_size
        self.docs = table.filter("pair IS NULL").select(*DOCS.names)
        self.postings = table.filter("pair IS NOT NULL").select("block", *POSTINGS.names)

    def counts(self) -> DataFrame:
        """``pair, a, b, n_docs, n_links`` of every linked pair."""
        weight = F.when(F.col("plane") == 0, F.col("n")).otherwise(F.call_function("shiftleft", F.col("n"), F.col("plane") - 1))
        sums = self.postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"),
                                                 F.sum(weight).alias("n_links"))
        return sums.select("pair", F.floor(F.col("pair") / self.b_size).alias("a"), (F.col("pair") % self.b_size).alias("b"),
                           "n_docs", "n_links")

    def scores(self) -> DataFrame:
        """``block, offset, n_best, count_sum`` of every document with links."""
        counts = saved(self.counts().select("pair", "a", "n_docs"), "pairs")
        best = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
        known = counts.join(best, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
        met = self.postings.join(known, "pair").select("block", "plane", "n", "dense", "docs", "n_docs", "best")
        return met.groupBy("block").applyInArrow(_block_scores, "block long, offset int, n_best long, count_sum long")


def _block_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of one block, a batch at a time: each gives its documents its
    pair's count, times the plane's weight."""
    best, total, held, block = (np.zeros(BLOCK_DOCS, t) for t in (np.int64, np.int64, bool, np.int64))
    number = 0
    for batch in batches:
        number = batch.column(0)[0].as_py()
        plane, n, is_dense, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 5))
        is_best = batch.column(6).to_numpy(zero_copy_only=False)
        weight = np.left_shift(1, np.maximum(plane.astype(np.int64) - 1, 0))
        if is_dense.any():
            where = np.concatenate([offsets_of(d.as_py(), x) for d, x in zip(batch.column(4), is_dense.tolist())])
        else:
            where = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u2")
        np.add.at(total, where, np.repeat(weight * count, n))
        np.add.at(best, where, np.repeat(np.where(is_best, weight, 0), n))
        held[where] = True
    places = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), number), pa.int64()), pa.array(places, pa.int32()),
                                      pa.array(best[places]), pa.array(total[places])], ["block", "offset", "n_best", "count_sum"])


def build(docs: DataFrame, byte_spec: str, ranks: str, piece_model: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Encode and index every text; the files are read on the driver and sent
    to the executors."""
    with open(byte_spec, encoding="utf-8") as f, open(ranks, encoding="utf-8") as g, open(piece_model, "rb") as h:
        content = f.read(), g.read(), h.read()
    import sentencepiece
    b_size = sentencepiece.SentencePieceProcessor(model_proto=content[2]).get_piece_size()
    key = hashlib.sha256(repr([len(c) for c in content]).encode() + content[2]).hexdigest()
    files = docs.sparkSession.sparkContext.broadcast(content)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return Index(saved(texts.mapInArrow(_index(key, files), SCHEMA), "alignment"), b_size)


def align_documents(docs: DataFrame, byte_spec: str, ranks: str, piece_model: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` of every document."""
    index = build(docs, byte_spec, ranks, piece_model)
    out = index.docs.join(index.scores(), ["block", "offset"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
