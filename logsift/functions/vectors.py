"""Sparse vectors inside the row: terms to numbers, numbers to weights.

A bounded vocabulary travels in the plan as constants: a hash table of buckets
(``crc32`` of the term), so that a term finds its number in one probe whatever
the vocabulary's size, and arrays of weights indexed by that number.  No join,
no shuffle, no per-row copy of the table.  Expressions are SQL text, parsed
once; the optimizer folds the constants.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

from logsift.constants import MAX_FEATURES
from logsift.functions.text import sql_literal

# Terms that a constant may hold: four times the vocabulary cap.
MAX_TERMS = 4 * MAX_FEATURES


def constant(value: list, kind: str) -> str:
    return f"from_json({sql_literal(json.dumps(value))}, '{kind}')"


class Vocabulary:
    """``terms`` numbered by their place, with columns of numbers beside them.
    Methods take and give SQL text."""

    def __init__(self, terms: Sequence[str], **columns: Sequence[float]):
        if len(terms) > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} terms")
        self.n_buckets = 1 << max(4, (2 * len(terms)).bit_length())
        buckets: list[list[dict]] = [[] for _ in range(self.n_buckets)]
        for i, t in enumerate(terms):
            buckets[zlib.crc32(t.encode()) % self.n_buckets].append({"t": t, "i": i})
        self._buckets = constant(buckets, "array<array<struct<t: string, i: int>>>")
        self._terms = constant(list(terms), "array<string>")
        self._columns = {c: constant(list(map(float, v)), "array<double>") for c, v in columns.items()}

    def number(self, term: str) -> str:
        """The term's number, null where the vocabulary lacks it."""
        bucket = f"get({self._buckets}, cast(crc32({term}) % {self.n_buckets} AS int))"
        return f"get(filter({bucket}, e -> e.t = {term}), 0).i"

    def term(self, number: str) -> str:
        return f"get({self._terms}, {number})"

    def at(self, column: str, number: str) -> str:
        return f"get({self._columns[column]}, {number})"

    def vector(self, counts: str, scale: str) -> str:
        """``array<struct<i, x>>`` of counted terms (``array<struct<term,
        tf>>``): the known ones, ``x`` their count times ``scale``."""
        numbered = f"transform({counts}, c -> named_struct('i', {self.number('c.term')}, 'tf', c.tf))"
        return (f"transform(filter({numbered}, h -> h.i IS NOT NULL), "
                f"h -> named_struct('i', h.i, 'x', h.tf * {self.at(scale, 'h.i')}))")

    def dot(self, vector: str, column: str) -> str:
        return f"aggregate({vector}, 0D, (acc, h) -> acc + h.x * {self.at(column, 'h.i')})"


def norm(vector: str) -> str:
    return f"sqrt(aggregate({vector}, 0D, (acc, h) -> acc + h.x * h.x))"
