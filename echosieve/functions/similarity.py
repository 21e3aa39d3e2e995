"""Sequence similarity for sequences of any length, as Arrow-batched functions.

A common subsequence is counted in rows of bits: one unbounded integer holds a
bit for every place of the shorter sequence, so a row costs a few word
operations per 30 places.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import functions as F


def lcs_length(a: Sequence[Hashable], b: Sequence[Hashable], least: int = 0, every: int = 0) -> int:
    """Length of the longest common subsequence.

    With ``every``, 0 is returned as soon as, after a multiple of ``every`` rows,
    ``least`` is out of reach.
    """
    places: dict[Hashable, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    m, n, row = len(a), len(b), 0
    mask = (1 << n) - 1
    for i, x in enumerate(a, 1):
        top = row | places.get(x, 0)
        row = top & ((top - (row << 1 | 1)) ^ top) & mask
        if every and i % every == 0:
            have = row.bit_count()
            if have + min(m - i, n - have) < least:
                return 0
    return row.bit_count()


def lcs_dice(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """2 LCS / (a + b); 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    return 2.0 * lcs_length(long, short) / (len(a) + len(b))


def lcs_dice_threshold(a: Sequence[Hashable], b: Sequence[Hashable], threshold: float) -> float:
    """As ``lcs_dice``, but 0 once the threshold is found out of reach; how often that is looked at depends on the shorter length."""
    if not len(a) or not len(b):
        return 0.0
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    every = 4 if len(short) <= 64 else 8 if len(short) <= 256 else 16
    least = math.ceil(threshold * (len(a) + len(b)) / 2.0)
    return 2.0 * lcs_length(long, short, least, every) / (len(a) + len(b))


def blended(sa: Sequence, sb: Sequence, ta: Sequence, tb: Sequence, weight: float) -> float:
    """Structural and textual similarity, weighted."""
    s = lcs_dice(sa, sb)
    if weight <= 0 or not len(ta) or not len(tb):
        return s
    return (1.0 - weight) * s + weight * lcs_dice(ta, tb)


def blended_threshold(sa: Sequence, sb: Sequence, ta: Sequence, tb: Sequence, weight: float, threshold: float) -> float:
    """The blend with early exits in both parts; a text similarity found hopeless counts as 0."""
    s = lcs_dice_threshold(sa, sb, threshold)
    if weight <= 0 or not len(ta) or not len(tb):
        return s
    if s == 0.0:
        return 0.0 if weight < threshold else blended(sa, sb, ta, tb, weight)
    return (1.0 - weight) * s + weight * lcs_dice_threshold(ta, tb, threshold)


def lcs_alignment(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[list[bool], list[bool]]:
    """Which places of each sequence are matched; where both ways are as good, ``a`` is stepped back first."""
    m, n = len(a), len(b)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    in_a, in_b = [False] * m, [False] * n
    i, j = m, n
    while i and j:
        if a[i - 1] == b[j - 1]:
            in_a[i - 1] = in_b[j - 1] = True
            i, j = i - 1, j - 1
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return in_a, in_b


def lcs_dice_udf():
    """Column function of two arrays: their ``lcs_dice``."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_dice(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def bag_dice(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """Upper bound of ``lcs_dice``: the common multiset in place of the common subsequence."""
    return 2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if len(a) or len(b) else 0.0


def blended_udf(weight: float, threshold: float, mode: str, bound: bool = False):
    """Similarity of (sa, sb, ta, tb) in ``exact`` or ``compat`` mode; with ``bound``, -1 where the structural bags can't reach the threshold."""

    @F.pandas_udf("double")
    def run(sa: pd.Series, sb: pd.Series, ta: pd.Series, tb: pd.Series) -> pd.Series:
        out = []
        for w, x, y, z in zip(sa, sb, ta, tb, strict=True):
            y, z = ([] if v is None else v.tolist() for v in (y, z))
            w, x = w.tolist(), x.tolist()
            if bound and bag_dice(w, x) < threshold:
                out.append(-1.0)
                continue
            out.append(blended_threshold(w, x, y, z, weight, threshold) if mode == "compat" else blended(w, x, y, z, weight))
        return pd.Series(out, dtype="float64")

    return run


def lcs_alignment_udf():
    """Column function of two arrays: their ``lcs_alignment``. Quadratic in memory, so for pairs that are reported."""

    @F.pandas_udf("struct<matched_a:array<boolean>,matched_b:array<boolean>>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        both = [lcs_alignment(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"matched_a": [x for x, _ in both], "matched_b": [y for _, y in both]})

    return run
