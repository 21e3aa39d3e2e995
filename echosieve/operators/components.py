"""Connected components of an edge list, by alternating large-star and small-star.

Both steps are one grouped minimum and one join-free re-pairing, so no vertex's
whole neighbourhood has to meet in one task: the minimum is pre-aggregated on
the map side, and the re-pairing joins the edges with the per-vertex minimum,
where adaptive execution may split a hot vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echosieve.storage import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v or any order.

    large: every neighbour above u links to the least of u and its neighbours.
    small: u and its lower neighbours link to the least of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex on an edge; component is its least vertex.

    Rows with a null end and self-loops add nothing. Each round is written to
    the shared scratch folder, so lineage stays short and survives lost
    executors; the round before is deleted. The loop ends when a round changes no edge, which is judged by
    the edges' count and a sum of their hashes.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    now = materialize(now, "cc")
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialize(_star(_star(now, True), False), "cc")
        discard(before)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == mark:
            break
        mark = (row.n, row.s)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
