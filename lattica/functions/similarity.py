"""String and header similarity: native expressions for single pairs, cached bit-parallel comparison for many."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LCS = (
    "element_at(aggregate(split({a}, ''), transform(sequence(0, length({b})), z -> 0), (p, x) -> "
    "aggregate(sequence(1, length({b})), array(0), (q, j) -> concat(q, array("
    "CASE WHEN substring({b}, j, 1) = x THEN p[j - 1] + 1 ELSE greatest(p[j], q[j - 1]) END)))), -1)"
)


def indel_ratio_sql(a: str, b: str) -> str:
    """200 * LCS / (length + length), 100 for two empty strings; usable inside a lambda."""
    return (
        f"CASE WHEN {a} = {b} THEN 100D WHEN length({a}) = 0 OR length({b}) = 0 THEN 0D "
        f"ELSE 200D * {_LCS.format(a=a, b=b)} / (length({a}) + length({b})) END"
    )


def header_similarity(a: str, b: str) -> Column:
    """Mean over the first headers of the best ratio among the second; 0 if either is empty. Not symmetric."""
    best = f"array_max(transform({b}, y -> {indel_ratio_sql('lower(trim(x))', 'lower(trim(y))')}))"
    return F.expr(
        f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE aggregate(transform({a}, x -> {best}), 0D, (s, v) -> s + v) / size({a}) / 100D END"
    )


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one step of whole-number bit operations for each character of ``b``."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(200_000)
def indel_ratio(a: str, b: str) -> float:
    """The ratio of ``indel_ratio_sql`` as a share of 1."""
    if a == b:
        return 1.0
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def normal(header: str | None) -> str:
    """How headers are compared: without spaces at the ends and without case."""
    return (header or "").strip(" ").lower()


def normal_headers(headers: str) -> Column:
    """A column of headers in the form in which they are compared."""
    return F.transform(headers, lambda h: F.lower(F.trim(F.coalesce(h, F.lit("")))))


def list_similarity(a: list[str], b: list[str]) -> float:
    """``header_similarity`` of two lists of normal headers."""
    if not a or not b:
        return 0.0
    return sum(100 * max(indel_ratio(x, y) for y in b) for x in a) / len(a) / 100


@F.pandas_udf(DoubleType())
def normal_list_similarity_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([list_similarity(list(x), list(y)) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(DoubleType())
def indel_ratio_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype=float)
