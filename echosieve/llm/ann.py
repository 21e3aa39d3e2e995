"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a string of sign bits of random projections and keeps
its shard's strings in a sorted array. A query descends each array to its
longest matching prefix, then all trees ascend together, one bit at a time: the
rows that share the shorter prefix join the candidates until enough are found.
Candidates are ranked by exact cosine in double precision.

The rows are split into shards of bounded size. A task holds one shard's forest,
built once, and the queries stream past it; the best few of all shards are merged.
The candidate budget is a share of a shard, so recall doesn't depend on the
number of rows (isotropic vectors have no short cut: the nearest are hardly
nearer than the rest, and a fixed budget would lose recall as the rows grow).
Many trees make the share small: their longer prefixes tell more. The last level of
the ascent is taken tree by tree, so that the share is met closely.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; so do rows of another dimension than the most frequent
(ties: the larger). Equal vectors form one class, searched once; the class keeps
the smallest ``k + 1`` ids, which is all that ``k`` results with ties to the
smaller id can need. Repeated ids are separate candidates, and separate queries with
a list each, even if their vectors are equal; a query leaves out one row with its id
and vector, itself. Rows with a null id are left out. Fewer than ``k`` candidates give
fewer rows; an empty table none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echosieve.storage import materialize

_FOUND = "query long, query_id long, vec_id long, score double"


def hash_strings(x: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """(rows, trees) strings of up to 32 sign bits, the first bit most significant."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * bits)).astype(np.float32)
    out = np.zeros((len(x), trees, 4), np.uint8)
    for a in range(0, len(x), 1024):
        signs = (x[a : a + 1024].astype(np.float32) @ planes > 0).reshape(-1, trees, bits)
        out[a : a + 1024, :, : -(-bits // 8)] = np.packbits(signs, axis=2)
    return out.view(">u4")[:, :, 0].astype(np.uint32)


class Forest:
    """Sorted arrays of hash strings of one shard, one for each tree."""

    def __init__(self, x: np.ndarray, trees: int, bits: int, seed: int):
        self.bits, self.trees, self.seed, self.n = bits, trees, seed, len(x)
        keys = hash_strings(x, trees, bits, seed).T
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def _range(self, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree and query the range of rows that share ``depth`` bits with the query."""
        rest = np.uint32((1 << (32 - depth)) - 1) if depth else np.uint32(0xFFFFFFFF)
        low, high = keys & ~rest, keys | rest
        return (
            np.stack([np.searchsorted(self.keys[t], low[:, t], "left") for t in range(self.trees)]),
            np.stack([np.searchsorted(self.keys[t], high[:, t], "right") for t in range(self.trees)]),
        )

    def _rows(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """All rows in one range of each tree, with repeats."""
        many = hi - lo
        tree = np.repeat(np.arange(self.trees), many)
        return self.order[tree, np.arange(len(tree)) - np.repeat(np.cumsum(many) - many - lo, many)]

    def candidates(self, q: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows of the longest prefixes, at least ``least`` if there are as many."""
        keys = hash_strings(q, self.trees, self.bits, self.seed)
        levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def at(depth: int) -> tuple[np.ndarray, np.ndarray]:
            if depth not in levels:
                levels[depth] = self._range(keys, depth)
            return levels[depth]

        for i in range(len(q)):
            # descend: the longest prefixes that all trees together have enough rows for, if none of them were the same
            depth = self.bits
            while depth and int((at(depth)[1][:, i] - at(depth)[0][:, i]).sum()) < least:
                depth -= 1
            while True:
                lo, hi = at(depth)[0][:, i], at(depth)[1][:, i]
                seen = np.zeros(self.n, bool)
                seen[self._rows(lo, hi)] = True
                if depth == 0 or np.count_nonzero(seen) >= least:
                    break
                depth -= 1
            if depth < self.bits:
                # ascend the last bit tree by tree
                below = at(depth + 1)
                rows = np.concatenate((self._rows(below[0][:, i], below[1][:, i]), self._rows(lo, hi)))
                first = np.sort(np.unique(rows, return_index=True)[1])
                seen = np.zeros(self.n, bool)
                within = int((below[1][:, i] - below[0][:, i]).sum())
                seen[rows[first[: max(least, int(np.searchsorted(first, within)))]]] = True
            yield np.flatnonzero(seen)


class _Shard:
    """The points of one shard and their forest."""

    def __init__(self, vectors: list, ids: list, trees: int, bits: int, seed: int, share: float, least: int):
        self.x = np.array(vectors, np.float64)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.ids = [sorted(v) for v in ids]
        self.forest = Forest(self.x / self.norm[:, None], trees, bits, seed)
        self.least = min(len(self.x), max(least, int(np.ceil(share * len(self.x)))))

    def search(self, y: np.ndarray, own: list[int], k: int) -> Iterator[tuple[int, int, float]]:
        """(number of the query, id, score) of the ``k`` nearest of each query."""
        norm = np.sqrt((y * y).sum(1))
        for i, got in enumerate(self.forest.candidates(y / norm[:, None], self.least)):
            score = (self.x[got] @ y[i]) / (self.norm[got] * norm[i])
            near = np.ones(len(got), bool)
            if len(got) > k + 1:
                # every class as near as the last one kept may hold a smaller id
                near = score >= np.partition(score, len(got) - k - 1)[len(got) - k - 1]
            rows = []
            for g, s in zip(got[near].tolist(), score[near].tolist(), strict=True):
                ids = list(self.ids[g])
                if own[i] in ids and (self.x[g] == y[i]).all():
                    ids.remove(own[i])
                rows += [(-s, v) for v in ids]
            for s, v in sorted(rows)[:k]:
                yield i, v, -s


def _search(trees: int, bits: int, seed: int, share: float, least: int, k: int, at_once: int = 1024):
    """Of each shard the points come first, then all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ids, shard = None, [], [], None
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                part = batch.slice(a, at_once)
                number, kind = part.column("shard").to_numpy(), part.column("kind").to_numpy()
                cut = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (kind[1:] != kind[:-1]), [True])))
                for x, y in zip(cut, cut[1:], strict=False):
                    if number[x] != now:
                        now, vectors, ids, shard = number[x], [], [], None
                    rows = part.slice(x, y - x)
                    if kind[x] == 0:
                        vectors += rows.column("vector").to_pylist()
                        ids += rows.column("ids").to_pylist()
                        continue
                    if not vectors:
                        continue
                    shard = shard or _Shard(vectors, ids, trees, bits, seed, share, least)
                    query, own = rows.column("query").to_pylist(), rows.column("own").to_pylist()
                    found = list(shard.search(np.array(rows.column("vector").to_pylist(), np.float64), own, k))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query": pa.array([query[i] for i, _, _ in found], pa.int64()), "query_id": pa.array([own[i] for i, _, _ in found], pa.int64()),
                            "vec_id": pa.array([v for _, v, _ in found], pa.int64()), "score": pa.array([s for _, _, s in found], pa.float64()),
                        }
                    )

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    trees: int = 256,
    bits: int = 32,
    share: float = 0.3,
    least: int = 256,
    shard_rows: int = 8192,
    seed: int = 17,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row.

    ``is_query`` is a condition on the id column. ``share`` and ``least`` bound the candidates of each shard
    from below; ``shard_rows`` bounds what one task holds.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"), is_query.alias("q"))
    ok = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = dims[0].d if dims else 0
    rows = rows.filter(F.size("vector") == dim)
    # one row for each distinct vector, with the few smallest ids; the limit is applied before the shuffle, too
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("r") <= k + 1)
    classes = ranked.groupBy("vector").agg(F.collect_list("id").alias("ids"))
    points = materialize(classes.withColumn("h", F.xxhash64("vector")), "ann-points")
    queries = rows.filter(F.coalesce("q", F.lit(False))).select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("own"), "vector")
    queries = materialize(queries, "ann-queries")
    shards = max(1, -(-points.count() // shard_rows))
    p = points.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("long").alias("own"), "vector", "ids")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "query", "own", "vector", F.lit(None).cast("array<bigint>").alias("ids"))
    dealt = p.unionByName(q).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_search(trees, bits, seed, share, least, k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
