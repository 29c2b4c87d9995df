"""Prefix trie of conversations by range minima over sorted common prefixes
(operator 12).

A conversation is a row of 16-byte digests, one a turn (role and text).  The
rows are sorted, so the members of every prefix lie side by side.  They are
dealt in blocks of the sorted order; in a block the lengths of the common
prefixes of neighbours are laid into a sparse table, and every candidate
prefix searches the ends of its own interval, to the left and to the right, by
binary steps over that table.  No stack, no order among the candidates: all of
them step together in numpy.  Smallest members are range minima too; children,
leaves and bytes are sums over intervals.

A prefix that goes on in the block before or behind is open.  A block knows the
neighbours' border rows, so what it counts of an open prefix adds up with the
other blocks' parts.  A block has at most as many open prefixes as its border
rows have turns.

Bounds: texts are digested in the scan and never cross the network; a
conversation's digests and sizes (20 bytes a turn) are one row, and a block
holds about ``BLOCK_TURNS`` turns, or one conversation.  The order is by digests
and then by id, so any number of equal conversations is dealt over blocks.  The
range partitioner samples sort keys on the driver (100 a block).  A list of the
members that end in one prefix is hashed in one stream, as a hash must be, a
piece at a time.

Defined cases: rows without ``conv_id`` belong to no conversation and are left
out; a null role or text is empty; rows of equal turn are ordered by their
digest, repeated rows are turns of their own; a conversation without turns is a
member of the root; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import saved, text_of

BLOCK_TURNS = 500_000
WIDTH = 16
NO_END = hashlib.sha256(b"").hexdigest()


# --- conversations -------------------------------------------------------------

def conversations_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text") -> DataFrame:
    """``conv_id, turns`` with the turns' digests (hexadecimal) and text bytes
    in order of ``turn``, null first."""
    who, said = text_of(F.col(f"`{role}`")), text_of(F.col(f"`{text}`"))
    whole = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    one = F.struct(F.col(f"`{turn}`").isNotNull().alias("known"), F.col(f"`{turn}`").alias("turn"),
                   F.substring(F.sha2(whole, 256), 1, 2 * WIDTH).alias("digest"), F.octet_length(said).alias("size"))
    rows = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), one.alias("one")).filter("conv_id IS NOT NULL")
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return lists.select("conv_id", F.transform("all", lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


def with_borrowed_heads(conversations: DataFrame, step: int = 5, most: int = 8) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation
    c - c % ``step``, where h is the checksum of c modulo ``most`` + 1."""
    convs = saved(conversations, "conversations")
    donors = convs.filter(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("donor"),
                                                               F.slice("turns", 1, most).alias("head"))
    mine = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % step).alias("donor"),
                        (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int").alias("h"))
    joined = mine.join(donors, "donor", "left")
    none = F.array().cast(convs.schema["turns"].dataType)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def sort_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, key, sizes``: the digests end to end."""
    digests = F.transform("turns", lambda t: t["digest"])
    return conversations.select("conv_id", F.unhex(F.array_join(digests, "")).alias("key"),
                                F.transform("turns", lambda t: t["size"]).alias("sizes"))


# --- one block -------------------------------------------------------------------

def shared(a: bytes | None, b: bytes | None) -> int:
    """Turns that two rows begin with alike; -1 where there is no neighbour."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(k, "<u8", 2 * n).reshape(n, 2) for k in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


class RangeMin:
    """Sparse table: the minimum of any range in two lookups."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of the ranges ``first..last``, both included."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            table = self.levels[level]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << int(level)) + 1])
        return out

    def reach_right(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last row that shares ``depth`` turns with the row ``place``; the
        table's entry j stands between rows j and j + 1."""
        at = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table, step = self.levels[k], 1 << k
            fits = at < len(table)
            go = fits & (table[np.where(fits, at, 0)] >= depth) if len(table) else fits & False
            at[go] += step
        return at

    def reach_left(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First such row."""
        at = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table, step = self.levels[k], 1 << k
            fits = at >= step
            go = fits & (table[np.where(fits, at - step, 0)] >= depth) if len(table) else fits & False
            at[go] -= step
        return at


def neighbour_prefixes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before it, from the second on:
    all pairs are compared together, turn by turn."""
    out = np.zeros(len(length) - 1, np.int64)
    least = np.minimum(length[:-1], length[1:])
    t, left = 0, np.flatnonzero(least > 0)
    while len(left):
        left = left[(data[start[left] + t] == data[start[left + 1] + t]).all(axis=1)]
        out[left] += 1
        t += 1
        left = left[least[left] > t]
    return out


def chain(key: bytes, depth: int) -> list[bytes]:
    """Names of the first ``depth`` + 1 prefixes of a row, the root's first."""
    h = hashlib.sha256()
    out = [h.digest()]
    for d in range(depth):
        h.update(key[WIDTH * d:WIDTH * (d + 1)])
        out.append(h.digest())
    return out


LOCAL = ("depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, held long, "
         "made long, before long, ends_sha256 string, ends string, key binary, parent_key binary, block int")


def block_nodes(rows: pa.Table, before: bytes | None, behind: bytes | None, block: int) -> pa.Table:
    """The block's prefixes as ``LOCAL``.  Open ones carry ``key``; ``ends``
    are their members in this block that end there.  ``held``: text bytes of
    the members; ``made``: text bytes of the prefixes below (and of itself)
    whose first member is in this block; ``before``: those of the prefix above."""
    ids, keys = rows["conv_id"].to_pylist(), rows["key"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (keys[i], ids[i]))
    keys, ids = [keys[i] for i in order], np.array(ids, np.int64)[order]
    sizes = rows["sizes"].combine_chunks().take(pa.array(order)).flatten().to_numpy(zero_copy_only=False)
    n = len(keys)
    length = np.array([len(k) // WIDTH for k in keys], np.int64)
    start = np.concatenate([[0], np.cumsum(length)])
    bytes_to = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    data = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    inner = neighbour_prefixes(data, start, length)
    left_share, right_share = shared(before, keys[0]), shared(keys[-1], behind)
    share = np.concatenate([[left_share], inner, [right_share]])

    # Candidates: the prefixes that a row does not share with the row before it.
    first_depth = np.concatenate([[0], inner + 1])
    many = length - first_depth + 1
    offset = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(n), many)
    depth = np.arange(offset[-1]) - offset[row] + first_depth[row]
    table = RangeMin(inner)
    left, right = table.reach_left(row, depth), table.reach_right(row, depth)
    above = table.reach_left(row, depth - 1)
    parent = np.where(depth > 0, offset[above] + depth - 1 - first_depth[above], -1)
    goes_back, goes_on = (left == 0) & (depth <= left_share), (right == n - 1) & (depth <= right_share)
    is_open = goes_back | goes_on
    conv = RangeMin(ids).least(left, right)

    # Sums over the intervals.
    whole = bytes_to[start[1:]] - bytes_to[start[:-1]]
    fresh = whole - (bytes_to[start[:-1] + np.maximum(share[:-1], 0)] - bytes_to[start[:-1]])
    running = lambda v: np.concatenate([[0], np.cumsum(v, dtype=np.int64)])
    held_to, fresh_to, leaf_to = running(whole), running(fresh), running(share[1:] < length)
    over = bytes_to[start[row] + np.maximum(depth - 1, 0)] - bytes_to[start[row]]
    made = np.where(goes_back, fresh_to[right + 1] - fresh_to[0],
                    whole[left] - over + fresh_to[right + 1] - fresh_to[left + 1])
    counted = (depth > 0) & ~goes_back
    children = np.bincount(parent[counted], minlength=len(row))

    # Members that end in a prefix lie first in its interval.
    alike = np.concatenate([[False], (inner == length[1:]) & (length[:-1] == length[1:])])
    stops = np.append(np.flatnonzero(~alike), n)
    ends, digests = [None] * len(row), [NO_END] * len(row)
    for c in np.flatnonzero(depth == length[row]).tolist():
        i = int(row[c])
        ends[c] = ",".join(map(str, ids[i:stops[np.searchsorted(stops, i, "right")]].tolist()))
        digests[c] = hashlib.sha256(ends[c].encode()).hexdigest()

    names: list[bytes | None] = [None] * len(row)
    places = np.flatnonzero(is_open).tolist()
    if places:
        chains = [chain(keys[0], int(depth[is_open & (left == 0)].max(initial=0))),
                  chain(keys[-1], int(depth[is_open & (right == n - 1)].max(initial=0)))]
        for c in places:
            names[c] = chains[0 if left[c] == 0 else 1][depth[c]]
    closed = ~is_open
    to_closed = (depth > 0) & closed[parent]
    return pa.table({
        "depth": pa.array(depth, pa.int32()), "conv_id": conv,
        "parent_conv_id": pa.array(conv[parent], pa.int64(), mask=~to_closed),
        "n_convs": right - left + 1, "n_children": children.astype(np.int64),
        "n_leaves": leaf_to[right + 1] - leaf_to[left], "held": held_to[right + 1] - held_to[left], "made": made,
        "before": over, "ends_sha256": pa.array(digests, pa.string()),
        "ends": pa.array([e if o else None for e, o in zip(ends, is_open.tolist())], pa.string()),
        "key": pa.array(names, pa.binary()),
        "parent_key": pa.array([names[p] if p >= 0 else None for p in parent.tolist()], pa.binary()),
        "block": pa.array(np.full(len(row), block), pa.int32())})


# --- Spark -----------------------------------------------------------------------

def _with_neighbours(rows: pa.Table, borders: pa.Table) -> pa.Table:
    border = borders.to_pylist()[0]
    return block_nodes(rows, border["before"], border["behind"], border["block"])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each key, which come in order."""
    now, h, out = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in out], pa.binary()),
                                           "ends_sha256": pa.array([d for _, d in out], pa.string())})
    for batch in batches:
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(2)):
            if key != now:
                if h:
                    out.append((now, h.hexdigest()))
                now, h = key, hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.as_buffer())
        if len(out) > 10_000:
            yield flush()
            out = []
    if h:
        out.append((now, h.hexdigest()))
        yield flush()


def blocks_of(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``rows`` dealt by ranges of the sorted order, with their ``block``."""
    spark = rows.sparkSession
    turns = rows.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // block_turns))
    return saved(rows.repartitionByRange(n, "key", "conv_id").withColumn("block", F.spark_partition_id()), "blocks")


def local_nodes(blocks: DataFrame) -> DataFrame:
    """``LOCAL`` rows of all blocks."""
    borders = saved(blocks.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high")), "borders")
    # One row a block, in one task.
    w = Window.orderBy("block")
    beside = borders.select("block", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("behind"))
    pairs = blocks.groupBy("block").cogroup(saved(beside, "beside").groupBy("block"))
    return saved(pairs.applyInArrow(_with_neighbours, LOCAL), "prefixes")


def prefix_nodes(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each distinct prefix of ``rows`` (``conv_id, key, sizes``)."""
    local = local_nodes(blocks_of(saved(rows, "rows"), block_turns))
    parts = local.filter("key IS NOT NULL")
    ends = (parts.filter("ends IS NOT NULL").select("key", "block", "ends").repartition("key")
            .sortWithinPartitions("key", "block").mapInArrow(_hash_ends, "key binary, ends_sha256 string"))
    sums = parts.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), F.max("before").alias("before"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "held", "made")])
    merged = saved(sums.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_END))), "open")
    top = merged.filter("depth = 0").select("conv_id").first()
    root = F.lit(top and top[0]).cast("long")

    tokens = F.col("held") - F.col("n_convs") * F.col("before") - F.col("made")
    out = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
           tokens.alias("saved_tokens"), "ends_sha256"]
    up = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    closed = local.filter("key IS NULL")
    below_root = closed.filter("depth < 2").withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.when(F.col("depth") == 1, root)))
    inside = closed.filter("depth > 1 AND parent_key IS NULL")
    # A block's open prefixes by block, so that no parent's children of all blocks meet.
    up_here = parts.select("block", F.col("key").alias("parent_key")).distinct().join(up, "parent_key")
    under_open = closed.filter("depth > 1 AND parent_key IS NOT NULL").drop("parent_conv_id").join(up_here, ["block", "parent_key"])
    opened = merged.join(up, "parent_key", "left")
    return (below_root.select(*out).unionByName(inside.select(*out)).unionByName(under_open.select(*out))
            .unionByName(opened.select(*out)))


def trie(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    return prefix_nodes(sort_rows(with_borrowed_heads(conversations_of(turns))), block_turns)
