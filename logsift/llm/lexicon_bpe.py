"""Byte-level BPE with a minimal acyclic transducer as lexicon (operator 4).

The corpus' frequent words are counted in Spark, merged once on the driver and
compiled into a minimal acyclic transducer: words share prefixes and suffixes,
the outputs along a word's path add up to its number, and the number points to
its token ids.  The transducer is one flat file that Spark ships to the
executors, where it is memory-mapped.  A word that it lacks is merged exactly
by the merge ranks.  Decoding maps ids to bytes.

A "word" here is an optional space and the run of other characters behind it,
or a run of white space; the tokenizer splits words further, never across.

Bounds: at most ``LEXICON_WORDS`` words reach the driver; a worker's memory of
recent words is bounded by ``MEMO`` (it only saves time).

Defined cases: a null or empty text has no ids and decodes to the empty text;
special tokens inside a text become their ids, as in the tokenizers library;
an empty table compiles an empty lexicon.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import Recent, saved, shared_dir

LEXICON_WORDS = 50_000
MEMO = 350_000
PARTIAL_COUNTS = 400_000
MAGIC = 0x4D414654
HEAP_FROM = 48
CHUNK_CHARS = 1_000_000
DECODE_IDS = 1 << 18

# The white space class and the split pattern of the tokenizer.
SPACE = "\t-\r \x85\xa0  -     　"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_units = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
_pieces = regex.compile(SPLIT).findall
# Words that the library's splitter and the ranks' cut alike.
_plain = re.compile(" ?[!-~\xa1-\u024f]+").fullmatch
# Beyond Latin the library's own splitter decides: its Unicode tables may be
# of another version than the regex module's.
_beyond_latin = re.compile("[ɐ-\U0010ffff]").search


def by_width(words: list[bytes], step: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of similar length as rows of one byte matrix padded with zeros:
    (places in ``words``, lengths, matrix)."""
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(-(-len(word) // step) * step, []).append(i)
    for width, members in groups.items():
        rows = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in members]), np.uint8)
        n = np.fromiter((len(words[i]) for i in members), np.int64, len(members))
        yield np.array(members), n, rows.reshape(-1, width)


class Vocabulary:
    """Ranks and ids read from a tokenizer file's JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(kept)]
        shown = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}
        to_bytes = lambda s: bytes(shown[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: to_bytes(t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        self.byte_id = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 20 | vocab[right]] = n
            self.merged.append(vocab[left + right])
        self.none = len(self.merged)
        # Ids in the order of the merges are ranks themselves.
        self.ordered, self._by_rank = all(a < b for a, b in zip(self.merged, self.merged[1:])), None
        size = max(self.bytes_of) + 1
        self.width = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.special_split = (re.compile("(" + "|".join(map(re.escape, self.specials)) + ")").split
                              if self.specials else None)
        self._text, self._library = text, None

    def pieces(self, unit: str) -> list[str]:
        if not _beyond_latin(unit):
            if (unit[1:] if unit[0] == " " else unit).isalpha():
                return [unit]
            return _pieces(unit)
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_str(self._text).pre_tokenizer
        return [unit[a:b] for _, (a, b) in self._library.pre_tokenize_str(unit)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank, leftmost first."""
        parts = [self.byte_id[b] for b in piece]
        if len(parts) > HEAP_FROM:
            return self._merge_long(parts)
        rank, none, merged = self.rank.get, self.none, self.merged
        ranks = [rank(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], none)
        return parts

    def many(self, units: list[str]) -> list[bytes]:
        """Packed ids of many words.  Plain ones are merged in one call by the
        same ranks: each stands behind a line end, which is a token of its own
        and never part of another, and is cut out by its bytes."""
        out = [b""] * len(units)
        plain = [i for i, u in enumerate(units) if _plain(u)] if self.ordered else []
        if plain:
            ends = np.cumsum([len(units[i].encode()) + 1 for i in plain])
            ids = np.array(self._ranks().encode_ordinary("\n" + "\n".join([units[i] for i in plain])), "<u4")
            bytes_to = np.cumsum(self.width[ids])
            last = np.searchsorted(bytes_to, ends) + 1
            first = np.concatenate([[0], last[:-1]])
            if last[-1] != len(ids) or (bytes_to[last - 1] != ends).any() or (ids[first] != self.byte_id[10]).any():
                raise ValueError("a token crosses a line end")
            data = ids.tobytes()
            for i, a, z in zip(plain, (4 * first + 4).tolist(), (4 * last).tolist()):
                out[i] = data[a:z]
        for i in set(range(len(units))).difference(plain):
            out[i] = packed(self.unit_ids(units[i]))
        return out

    def _ranks(self):
        if self._by_rank is None:
            import tiktoken
            ranks = {b: i for i, b in self.bytes_of.items() if i not in set(self.specials.values())}
            self._by_rank = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return self._by_rank

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap, for pieces of many bytes."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rank.get(parts[i] << 20 | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def unit_ids(self, unit: str) -> list[int]:
        return [i for p in self.pieces(unit) for i in self.merge(p.encode())]


class _Node:
    __slots__ = ("arcs", "final")

    def __init__(self):
        self.arcs, self.final = [], False


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Flat form of the minimal transducer of distinct words with their ids.

    Built from sorted words: when a word leaves the path of the one before,
    the states left behind are final and are merged with an equal state.
    """
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    first, final, labels, target, out, words_of = array("I"), bytearray(), bytearray(), array("I"), array("I"), []

    def freeze(node: _Node) -> int:
        key = (node.final, *node.arcs)
        state = register.get(key)
        if state is None:
            state = register[key] = len(first)
            first.append(len(labels))
            final.append(node.final)
            words = int(node.final)
            for label, to in node.arcs:
                labels.append(label)
                target.append(to)
                out.append(words)
                words += words_of[to]
            words_of.append(words)
        return state

    def leave(depth: int) -> None:
        while len(path) - 1 > depth:
            state = freeze(path.pop())
            path[-1].arcs.append((last[len(path) - 1], state))

    path, last = [_Node()], b""
    for word, _ in entries:
        leave(len(os.path.commonprefix([last, word])))
        path.extend(_Node() for _ in word[len(path) - 1:])
        path[-1].final = True
        last = word
    leave(0)
    root = freeze(path[0])
    first.append(len(labels))
    start, ids = array("I", [0]), array("I")
    for _, word_ids in entries:
        ids.extend(word_ids)
        start.append(len(ids))
    for flags in (final, labels):
        flags.extend(b"\0" * (-len(flags) % 4))
    head = struct.pack("<6I", MAGIC, len(first) - 1, len(target), root, len(entries), len(ids))
    return b"".join([head, first.tobytes(), target.tobytes(), out.tobytes(), start.tobytes(),
                     ids.tobytes(), bytes(final), bytes(labels)])


_ONE = [bytes([i]) for i in range(256)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Lexicon:
    """Reader of ``compile_lexicon``'s form over any buffer with ``find``."""

    def __init__(self, data: mmap.mmap | bytes):
        magic, states, arcs, self.root, words, ids = struct.unpack_from("<6I", data, 0)
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        view, at = memoryview(data), 24

        def ints(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n:at].cast("I")

        self.first, self.target, self.out = ints(states + 1), ints(arcs), ints(arcs)
        self.start, self.ids = ints(words + 1), ints(ids)
        self.final = view[at:at + states]
        self.labels_at = at + states + (-states % 4)
        self.data, self._arcs = data, None

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        state, number, base = self.root, 0, self.labels_at
        find, first, target, out = self.data.find, self.first, self.target, self.out
        for letter in map(_ONE.__getitem__, word):
            arc = find(letter, base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            number += out[arc]
            state = target[arc]
        if not self.final[state]:
            return None
        return self.ids[self.start[number]:self.start[number + 1]].tolist()


    def get_many(self, words: list[bytes]) -> list[bytes | None]:
        """Packed ids of each word that is in the lexicon: all words walk the
        transducer together, letter by letter."""
        if self._arcs is None:
            first = np.frombuffer(self.first, np.uint32).astype(np.int64)
            labels = np.frombuffer(self.data, np.uint8, len(self.target), self.labels_at)
            # Ascending, as a state's arcs are sorted by letter.
            self._arcs = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 8 | labels
        found: list[bytes | None] = [None] * len(words)
        if not len(self._arcs):
            return found
        target, outputs = np.frombuffer(self.target, np.uint32), np.frombuffer(self.out, np.uint32)
        for place, n, rows in by_width(words):
            state, number = np.full(len(place), self.root, np.int64), np.zeros(len(place), np.int64)
            for j in range(rows.shape[1] + 1):
                for k in np.flatnonzero(n == j).tolist():
                    if self.final[state[k]]:
                        i = int(number[k])
                        found[place[k]] = self.ids[self.start[i]:self.start[i + 1]].tobytes()
                if j == rows.shape[1]:
                    break
                key = state << 8 | rows[:, j]
                arc = np.searchsorted(self._arcs, key)
                arc[arc == len(self._arcs)] = 0
                on = np.flatnonzero((self._arcs[arc] == key) & (n > j))
                place, n, rows, arc = place[on], n[on], rows[on], arc[on]
                state, number = target[arc].astype(np.int64), number[on] + outputs[arc]
        return found


class Codec:
    """Encoder and decoder of one vocabulary and lexicon."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, memo: int | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.units = Recent(self._unit, memo or MEMO)
        self.parts = Recent(lambda piece: packed(vocabulary.merge(piece.encode())), (memo or MEMO) // 2)
        self.width = vocabulary.width
        self.letters = np.frombuffer(b"".join(vocabulary.bytes_of.get(i, b"") for i in range(len(self.width))), np.uint8)
        self.begin = np.cumsum(self.width) - self.width

    def _unit(self, unit: str) -> bytes:
        """Little-endian bytes of a word's ids: the lexicon's, else merged."""
        ids = self.lexicon.get(unit.encode())
        if ids is None:
            return b"".join(map(self.parts.__getitem__, self.vocabulary.pieces(unit)))
        return packed(ids)

    def _learn(self, units: Iterable[str]) -> None:
        """Put the ids of the words not met lately into memory: the lexicon's,
        the plain others merged together.  The rest is left to ``encode``."""
        young, longest = self.units, self.units.longest
        units = [u for u in units if u not in young and len(u) <= longest]
        fresh = [u for u in units if u not in young.elder]
        if len(young) + len(fresh) > young.most:
            young.turn()
            fresh = [u for u in units if u not in young.elder]
        found = self.lexicon.get_many([u.encode() for u in fresh])
        young.update((u, ids) for u, ids in zip(fresh, found) if ids is not None)
        unseen = [u for u, ids in zip(fresh, found) if ids is None and _plain(u)]
        young.update(zip(unseen, self.vocabulary.many(unseen)))

    def encode_many(self, texts: Iterable[str | None]) -> list[bytes]:
        """``encode`` of every text, whole texts in chunks of at least
        ``CHUNK_CHARS`` characters."""
        out, chunk, size = [], [], 0
        for text in texts:
            chunk.append(text or "")
            size += len(chunk[-1])
            if size >= CHUNK_CHARS:
                out += self._encode_chunk(chunk)
                chunk, size = [], 0
        return out + self._encode_chunk(chunk)

    def _encode_chunk(self, texts: list[str]) -> list[bytes]:
        units = [None if any(s in t for s in self.vocabulary.specials) else _units(t) for t in texts]
        self._learn(set().union(*filter(None, units)))
        lookup = self.units.__getitem__
        return [self.encode(t) if u is None else b"".join(map(lookup, u)) for t, u in zip(texts, units)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        lookup = self.units.__getitem__
        v = self.vocabulary
        if not v.special_split or not any(s in text for s in v.specials):
            return b"".join(map(lookup, _units(text)))
        out = []
        for part in v.special_split(text):
            if part in v.specials:
                out.append(struct.pack("<I", v.specials[part]))
            else:
                out.extend(map(lookup, _units(part)))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        numbers, out = np.frombuffer(ids or b"", "<u4"), []
        for k in range(0, len(numbers), DECODE_IDS):
            part = numbers[k:k + DECODE_IDS]
            width = self.width[part]
            end = np.cumsum(width)
            out.append(self.letters[np.repeat(self.begin[part] - end + width, width) + np.arange(end[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_LOADED: dict[str, Codec] = {}


def _codec(name: str, spec, memo: int | None) -> Codec:
    """This worker's codec; the lexicon is the file that Spark fetched."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Codec(Vocabulary(spec.value), Lexicon.mapped(SparkFiles.get(name)), memo)
    return _LOADED[name]


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"unit": pa.array(list(seen), pa.string()),
                                           "n": pa.array(list(seen.values()), pa.int64())})
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(_units(text.as_py() or ""))
            if len(seen) > PARTIAL_COUNTS:
                yield flush()
                seen = Counter()
    if seen:
        yield flush()


def frequent_words(docs: DataFrame, text: str = "text", limit: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words of all texts, with their counts: those above
    the lowest count bin (eight bins to a doubling) that leaves at most
    ``limit``.  Only the bins' sizes come to the driver, no word is sorted."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    counts = saved(texts.mapInArrow(_partial_counts, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
                   .withColumn("bin", F.floor(8 * F.log2("n"))), "words")
    cut, room = 0, limit
    for r in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        room -= r["count"]
        if room < 0:
            cut = r["bin"] + 1
            break
    return counts.filter(F.col("bin") >= cut).select("unit", "n")


def ship(spark: SparkSession, data: bytes) -> str:
    """Put a small file in the shared folder and have Spark fetch it to every
    executor, later ones too; returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/logsift-llm/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class BpeModel:
    """A tokenizer file with the lexicon of a corpus: ``encode`` and
    ``decode`` are column functions."""

    def __init__(self, spark: SparkSession, tokenizer_path: str, words: Iterable[str], memo: int | None = None):
        with open(tokenizer_path, encoding="utf-8") as f:
            text = f.read()
        vocabulary = Vocabulary(text)
        special = tuple(vocabulary.specials)
        words = [w for w in words if w and not any(s in w for s in special)]
        entries = [(w.encode(), np.frombuffer(ids, "<u4").tolist()) for w, ids in zip(words, vocabulary.many(words))]
        self.lexicon = compile_lexicon(entries)
        name, spec = ship(spark, self.lexicon), spark.sparkContext.broadcast(text)

        @F.pandas_udf("binary")
        def encode(texts: pd.Series) -> pd.Series:
            codec = _codec(name, spec, memo)
            return pd.Series(codec.encode_many(texts), dtype=object)

        @F.pandas_udf("string")
        def decode(ids: pd.Series) -> pd.Series:
            codec = _codec(name, spec, memo)
            return pd.Series([codec.decode(i) for i in ids], dtype=object)

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        return self._encode(text.cast("string"))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)


def fit(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = LEXICON_WORDS,
        memo: int | None = None) -> BpeModel:
    """``memo``: words that a worker remembers in each of two generations, for
    jobs whose workers need their memory for other stages too."""
    words = [r["unit"] for r in frequent_words(docs, text, limit).select("unit").collect()]
    return BpeModel(docs.sparkSession, tokenizer_path, words, memo)


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, ids, decoded`` of every document."""
    model = fit(docs, tokenizer_path, text, limit)
    ids = docs.select("doc_id", model.encode(F.col(f"`{text}`")).alias("ids"))
    return ids.select("doc_id", "ids", model.decode(F.col("ids")).alias("decoded"))


def digests(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    return encode_decode(docs, tokenizer_path, text).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
