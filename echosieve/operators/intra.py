"""Repeated regions inside one block.

Positions with equal windows seed pairs, which are extended both ways; regions
must not overlap. Of pairs that mostly cover each other the longest stays. All
of it concerns one block, so it is a map over blocks without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echosieve.config import IntraConfig

PAIRS = "array<struct<a_start:int,a_len:int,b_start:int,b_len:int,similarity:double>>"


def _overlap(s1: int, s2: int, n1: int, n2: int) -> int:
    return max(0, min(s1 + n1, s2 + n2) - max(s1, s2))


def _windows(ids: np.ndarray, w: int) -> np.ndarray:
    """A number for the window at each position, the same for equal windows only: numbers of doubled lengths, the last two overlapping."""
    rank, size = np.unique(ids, return_inverse=True)[1], 1
    while size < w:
        step = min(size, w - size)
        both = rank[: len(rank) - step] * (len(ids) + 1) + rank[step:]
        rank, size = np.unique(both, return_inverse=True)[1], size + step
    return rank


def _seeds(ids: np.ndarray, w: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, first position) of all pairs of equal windows that don't overlap, of windows with at most ``most`` positions; ascending."""
    rank = _windows(ids, w)
    at = np.argsort(rank, kind="stable")
    count = np.bincount(rank)
    at = at[np.repeat((count >= 2) & (count <= most), count)]
    left = count[(count >= 2) & (count <= most)]
    # pairs k places apart within their window's positions, for each k
    ends = np.repeat(np.cumsum(left), left)
    found = []
    for k in range(1, int(left.max(initial=0))):
        i = np.flatnonzero(np.arange(len(at)) + k < ends)
        found.append((at[i + k] - at[i], at[i]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gap, first = (np.concatenate(x) for x in zip(*found, strict=True))
    gap, first = gap[gap >= w], first[gap >= w]
    order = np.lexsort((first, gap))
    return gap[order], first[order]


def regions(ids: Sequence[int], texts: Sequence[int] | None, cfg: IntraConfig) -> list[tuple[int, int, int, int, float]]:
    """(a_start, a_len, b_start, b_len, similarity) of the repeated regions of one block.

    Seeds of one distance whose positions follow each other lie in the same run of
    equal ids, so a run is extended once, not from each of its seeds. A run longer
    than its distance overlaps its copy; only a seed at its very start gives a
    region then, as long as the distance.
    """
    n, w = len(ids), cfg.window
    if n < 2 * cfg.min_region or n < w:
        return []
    ids = np.asarray(ids, np.int64)
    gap, first = _seeds(ids, w, cfg.max_positions)
    if not len(gap):
        return []
    texts = np.asarray(texts, np.int64) if cfg.text_weight > 0 and texts is not None and len(texts) else None
    heads = np.flatnonzero(np.r_[True, (np.diff(gap) != 0) | (np.diff(first) != 1)])
    tails = np.r_[heads[1:], len(gap)] - 1
    found = set()
    for d, low, high in zip(gap[heads].tolist(), first[heads].tolist(), first[tails].tolist(), strict=True):
        start, end = low, high + w
        while start > 0 and ids[start - 1] == ids[start - 1 + d]:
            start -= 1
        while end < n - d and ids[end] == ids[end + d]:
            end += 1
        size = end - start
        if size > d:
            if start < low:
                continue
            size = d
        if size < cfg.min_region:
            continue
        similarity = 1.0
        if texts is not None:
            equal = int((texts[start : start + size] == texts[start + d : start + d + size]).sum())
            similarity = (1.0 - cfg.text_weight) + cfg.text_weight * (equal / size)
        if similarity >= cfg.threshold:
            found.add((start, size, start + d, size, similarity))
    kept: list[tuple[int, int, int, int, float]] = []
    for p in sorted(found, key=lambda p: (-p[1], -p[4], p[0], p[2])):
        covered = any(2 * _overlap(p[0], q[0], p[1], q[1]) > min(p[1], q[1]) and 2 * _overlap(p[2], q[2], p[3], q[3]) > min(p[3], q[3]) for q in kept)
        if not covered:
            kept.append(p)
    return kept


def detect_intra(blocks: DataFrame, cfg: IntraConfig = IntraConfig()) -> DataFrame:
    """(block_id, pairs) of the blocks with repeated regions; blocks too short for two are left out before the scan."""

    @F.pandas_udf(PAIRS)
    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        keys = ("a_start", "a_len", "b_start", "b_len", "similarity")
        return pd.Series([[dict(zip(keys, p, strict=True)) for p in regions(x, y, cfg)] for x, y in zip(ids, texts, strict=True)])

    texts = F.col("text_ids") if "text_ids" in blocks.columns else F.lit(None).cast("array<bigint>")
    rows = blocks.filter(F.size("struct_ids") >= 2 * cfg.min_region).select("block_id", run("struct_ids", texts).alias("pairs"))
    return rows.filter(F.size("pairs") > 0)


def ranked_intra(found: DataFrame) -> DataFrame:
    """Results by their longest region."""
    return found.withColumn("longest", F.array_max(F.transform("pairs", lambda p: F.greatest(p["a_len"], p["b_len"])))).orderBy(F.desc("longest"), "block_id")
