"""The prefix trie against a plain trie of dictionaries."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from logsift.llm import prefix_trie
from logsift.llm.queries import op12_prefix_trie
from tests.conftest import SF_SMALL


def rebuild(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    def digest(t):
        return hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], digest(t)))] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def brute(rows):
    members = {}
    for c, turns in rebuild(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, len(turns)))
    kids, leaves, tokens = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            tokens[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in m if n == len(p)))
        out.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), kids[p], leaves[p], tokens[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def nodes(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                               "saved_tokens", "ends_sha256").collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, b"k", 3, "x") for r in rows],
                                 "conv_id long, turn long, role string, text string, key binary, block int, parent_key string")


def check(spark, rows, block_turns=prefix_trie.BLOCK_TURNS):
    assert nodes(prefix_trie.trie(table(spark, rows), block_turns)) == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(op12_prefix_trie(spark, SF_SMALL)) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 0, "user", ""), (0, 0, "user", "a"), (0, 1, "u", "sera"), (1, 3, "user", "é€" * 50),
            (1, 2, "user", None), (2, 0, "a", "b"), (2, 0, "a", "b"), (None, 1, "user", "no conversation"), (-3, 0, "u", "neg"),
            (-5, 0, "u", "neg"), (7, 5, "", "x" * 100_000), (2**62, 0, "u", "big"), (11, 1, "us", "er"), (11, 1, "use", "r")]
    check(spark, rows)
    check(spark, [(3, 0, "u", "alone")])
    check(spark, [(0, 0, "u", "t"), (4, 0, "u", "t")])
    assert prefix_trie.trie(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_many_copies_over_many_blocks(spark, seed):
    """Common first turns, equal conversations, conversations that end inside
    others, dealt over blocks that cut them."""
    r = random.Random(seed)
    rows = []
    for c in range(700):
        turns = ["hot"] * (r.random() < 0.5) + [r.choice("abc") * r.randint(1, 3) for _ in range(r.choice([0, 1, 2, 3, 12]))]
        rows += [(c, i, "user", t) for i, t in enumerate(turns)]
    rows += [(c, i, "user", "same") for c in range(1000, 1300) for i in range(10)]
    rows += [(5000, i, "user", f"long {i // 2}") for i in range(90)] + [(5005, i, "user", f"long {i // 2}") for i in range(90)]
    check(spark, rows, block_turns=(500, 60, 1_000_000)[seed])


def test_searches_agree_with_a_scan():
    import numpy as np
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 65):
        between = r.integers(0, 5, n - 1)
        t = prefix_trie.RangeMin(between)
        place, depth = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(6)))
        left, right = t.reach_left(place, depth), t.reach_right(place, depth)
        for p, d, a, z in zip(place, depth, left, right):
            assert (between[a:z] >= d).all()
            assert (a == 0 or between[a - 1] < d or a == p == 0) and (z == n - 1 or between[z] < d)
