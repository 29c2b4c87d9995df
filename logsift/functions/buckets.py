"""Deterministic md5 buckets.

``bucket(key, salt)`` maps a key to an integer in ``[0, BUCKETS)`` from the
first 32 bits of ``md5(key || salt)``.  Unlike ``rand()`` it does not depend
on partitioning or retries, so a recomputed or replayed row lands in the same
bucket, and DuckDB computes the same number
(``('0x' || substr(md5(k || salt), 1, 8))::BIGINT % 10000``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.constants import BUCKETS


def bucket_text(key: str, salt: str) -> str:
    """The bucket as Spark SQL text; ``key`` is a column's name or expression."""
    return f"(cast(conv(substring(md5(concat(cast({key} AS string), '{salt}')), 1, 8), 16, 10) AS bigint) % {BUCKETS})"


def bucket(key: Column | str, salt: str) -> Column:
    if isinstance(key, str):
        return F.expr(bucket_text(f"`{key}`", salt))
    h = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.lit(BUCKETS)


def bucket_sql(key_sql: str, salt: str) -> str:
    """The same bucket as DuckDB SQL text (for oracles)."""
    return (f"(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '{salt}'), 1, 8))"
            f"::BIGINT % {BUCKETS})")


def cumulative_cuts(weights: list[float]) -> list[int]:
    """Bucket upper bounds for a weighted pick, e.g. [.7,.15,.05,.1] ->
    [7000, 8500, 9000, 10000]."""
    cuts, acc = [], 0.0
    for w in weights:
        acc += w
        cuts.append(int(round(acc * BUCKETS)))
    cuts[-1] = BUCKETS
    return cuts


def weighted_pick_text(bucket: str, values: list[str], weights: list[float]) -> str:
    """``values[i]`` for the first cumulative cut above the bucket."""
    cuts = cumulative_cuts(weights)
    whens = " ".join(f"WHEN {bucket} < {c} THEN '{v}'" for v, c in zip(values[:-1], cuts[:-1]))
    return f"CASE {whens} ELSE '{values[-1]}' END"


def pick_text(bucket: str, values: list[str]) -> str:
    """Uniform pick ``values[b % n]``."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({bucket} % {len(values)} AS int) + 1)"
