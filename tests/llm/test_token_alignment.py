"""Alignment against a plain count of all linked occurrences."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsift.llm import token_alignment as ta
from logsift.llm.queries import op11_token_alignment, tokenizer
from tests.conftest import SF_SMALL

FILES = tuple(map(tokenizer, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    byte = ta.letters_of_bytes()
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
    return a, b, a_bytes, piece


def brute(rows, sides):
    a, b, a_bytes, piece = sides
    links, parts, docs = [], [], defaultdict(set)
    for k, (_, text) in enumerate(rows):
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in x) != whole or b"".join(map(piece, y)) != whole:
            x, y = [], []
        groups, i, j, ea, eb = [], 0, 0, 0, 0
        while i < len(x):
            ga, gb = [x[i]], []
            ea, i = ea + len(a_bytes[x[i]]), i + 1
            while ea != eb:
                if ea < eb:
                    ga.append(x[i])
                    ea, i = ea + len(a_bytes[x[i]]), i + 1
                else:
                    gb.append(y[j])
                    eb, j = eb + len(piece(y[j])), j + 1
            groups.append((ga, gb))
        times = Counter()
        for ga, gb in groups:
            ca, cb = Counter(ga), Counter(gb)
            for u in ca:
                for v in cb:
                    times[u, v] += ca[u] * cb[v]
                    docs[u, v].add(k)
        links.append(times)
        parts.append((len(x), len(y), groups))
    most = Counter()
    for (u, _), d in docs.items():
        most[u] = max(most[u], len(d))
    out = []
    for (doc_id, _), times, (na, nb, groups) in zip(rows, links, parts):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, na, nb, len(groups), sum(times.values()),
                    sum(t for (u, v), t in times.items() if len(docs[u, v]) == most[u]),
                    sum(t * len(docs[p]) for p, t in times.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_odd_rows(odd, none, sides):
    got = found(ta.align_documents(odd, *FILES))
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()], sides)
    assert ta.align_documents(none, *FILES).count() == 0


def test_query(spark, sides):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert found(op11_token_alignment(spark, SF_SMALL)) == brute(rows, sides)


def test_small_blocks_and_wide_groups(spark, sides, monkeypatch):
    """Dense containers, several planes, blocks that end early, groups that
    are linked by distinct ids."""
    texts = ["hot words here " * 3, "x" * 900 + " tail", "日本語のテキスト" * 5, "<|endoftext|> plain text", "a  b\n\n c\t", "hot"] * 40
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute(rows, sides)
    for name, value in (("WIDE_GROUP", 3), ("SPARSE", 2), ("BLOCK_LINKS", 300)):
        monkeypatch.setattr(ta, name, value)
    a = ta.Aligner(*(open(f, "rb").read() if f.endswith("model") else open(f, encoding="utf-8").read() for f in FILES))
    whole = list(a.align([t for _, t in rows]))
    many = np.array([len(x.pairs) for x in whole])
    pair, times = np.concatenate([x.pairs for x in whole]), np.concatenate([x.times for x in whole])
    offset = np.repeat(np.arange(len(rows)), many)
    seen = defaultdict(lambda: np.zeros(len(rows), np.int64))
    n_dense = 0
    for t in ta.postings(pair, offset, times, 0):
        for r in t.to_pylist():
            at = ta.offsets_of(r["docs"], r["dense"])
            assert len(at) == r["n"]
            n_dense += r["dense"]
            seen[r["pair"]][at] += 1 if r["plane"] == 0 else 1 << (r["plane"] - 1)
    assert n_dense
    for p in np.unique(pair):
        real = np.zeros(len(rows), np.int64)
        real[offset[pair == p]] = times[pair == p]
        assert (seen[p] == real).all()
    n_links = Counter((r, len(whole[r].pairs), whole[r].n_links) for r in range(len(rows)))
    assert sum(x for _, _, x in n_links) == sum(k[4] for k in want.elements())


def test_pair_counts(spark, sides):
    docs = spark.createDataFrame([(i, "the same words") for i in range(30)] + [(99, "the the the")], "doc_id long, text string")
    index = ta.build(docs, *FILES)
    counts = index.counts()
    links = index.docs.agg(F.sum("n_links")).first()[0]
    assert counts.agg(F.sum("n_links")).first()[0] == links and counts.agg(F.max("n_docs")).first()[0] == 31
