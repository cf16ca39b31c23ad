"""Indel similarity scores (0 to 100) as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs_length(a, b) / n


def sorted_ratio(a: str, b: str) -> float:
    """indel_ratio of the words in sorted order."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """Best ratio between the common words and the common words with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 100.0
    scores = [indel_ratio(left, right)]
    if both:
        scores += [indel_ratio(both, left), indel_ratio(both, right)]
    return max(scores)


def partial_ratio(a: str, b: str) -> float:
    """Best indel_ratio of the shorter string with a window of its length (or less, at the ends) in the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 100.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(indel_ratio(short, w) for w in windows if w)


def _udf(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


ratio_udf, sorted_ratio_udf, set_ratio_udf, partial_ratio_udf = map(_udf, (indel_ratio, sorted_ratio, set_ratio, partial_ratio))
