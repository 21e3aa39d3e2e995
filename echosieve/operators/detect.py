"""Search for similar blocks.

Blocks of equal content are one class from the start: windows, candidate pairs
and similarities are computed between classes, and classes carry how many blocks
they hold, so a block that occurs a million times is one row in every join. The
frequency cap, the averages and the group sizes count blocks. ``expand_pairs``
gives the pairs of blocks for whoever wants them.

Order of the cascade: windows shared, adaptive least number, length ratio, then
the sequences are fetched, once, for the bag bound and, for what it leaves, the
alignment.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.config import DetectConfig
from echosieve.functions import columns as C
from echosieve.functions.similarity import blended_udf
from echosieve.operators.components import connected_components
from echosieve.storage import materialize


@dataclass
class Detection:
    """classes (class_id, n, blocks' length and sequences), members (block_id, class_id), pairs (a, b, similarity) between classes, a = b for the blocks of one class, groups (block_id, group_id) and averages (group_id, size, avg_similarity, first_block)."""

    classes: DataFrame
    members: DataFrame
    pairs: DataFrame
    groups: DataFrame
    averages: DataFrame


def content_classes(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of blocks (block_id, struct_ids, text_ids) of equal content, and the members. A class is named by its least block."""
    key = F.xxhash64("struct_ids", "text_ids")
    second = F.xxhash64(F.lit(1), "struct_ids", "text_ids")
    keyed = materialize(blocks.select("block_id", "struct_ids", "text_ids", key.alias("k1"), second.alias("k2")), "blocks")
    least = keyed.groupBy("k1", "k2").agg(F.min("block_id").alias("class_id"), F.count("*").alias("n"))
    members = materialize(keyed.select("block_id", "k1", "k2").join(least, ["k1", "k2"]).select("block_id", "class_id", "n"), "members")
    own = keyed.join(members.filter(F.col("block_id") == F.col("class_id")), "block_id")
    classes = own.select("class_id", "n", F.size("struct_ids").cast("bigint").alias("len"), "struct_ids", "text_ids")
    return materialize(classes, "classes"), members.select("block_id", "class_id")


def fingerprints(classes: DataFrame, window: int) -> DataFrame:
    """(class_id, n, len, fp): the distinct windows of each class."""
    return classes.select("class_id", "n", "len", F.explode(F.array_distinct(C.window_hashes(F.col("struct_ids"), window))).alias("fp"))


def frequency_cap(blocks: int) -> int:
    """Most blocks that a window may occur in."""
    return max(50, blocks // 2)


def capped(prints: DataFrame, cap: int) -> DataFrame:
    """The windows of two blocks at least and ``cap`` at most, with ``classes``, the number of classes that hold the window."""
    counts = prints.groupBy("fp").agg(F.sum("n").alias("blocks"), F.count("*").alias("classes")).filter((F.col("blocks") >= 2) & (F.col("blocks") <= cap))
    return prints.join(counts.select("fp", "classes"), "fp")


def _common(kept: DataFrame, allowed: Column) -> DataFrame:
    """(a, b, len_a, len_b) for each window that two classes have in common."""
    side = lambda s: kept.select("fp", F.col("class_id").alias(s), F.col("len").alias(f"len_{s}"))
    return side("a").join(side("b"), "fp").filter((F.col("a") < F.col("b")) & allowed).drop("fp")


def _common_hot(kept: DataFrame, allowed: Column, ratio: float | None, most: int) -> DataFrame:
    """As ``_common``, for windows of many classes: no task joins more than about ``most`` classes with twice as many.

    Classes are put into bands of length so wide that a pair of the given length
    ratio lies in one band or in two that follow each other, and dealt by a hash
    within the band. A cell is a pair of deals of a band; the lower class of a pair
    (by band, then by id) is copied to the cells of its deal as first, the upper one
    to those of its deal as second, in its own band and the one below.
    """
    width = math.log((2.0 - ratio) / ratio) + 1e-9 if ratio and 0 < ratio < 1 else None
    band = F.floor(F.log(F.greatest("len", F.lit(1))) / width).cast("int") if width else F.lit(0)
    rows = kept.select("fp", F.col("class_id").alias("id"), "len", band.alias("band"))
    fullest = rows.groupBy("fp", "band").count().groupBy("fp").agg(F.ceil(F.max("count") / most).cast("int").alias("deals"))
    rows = rows.join(fullest, "fp").withColumn("deal", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("deals") - 1))
    low = rows.select("fp", F.col("band").alias("cell"), F.col("deal").alias("first"), others.alias("second"), F.col("id").alias("low"), F.col("len").alias("len_low"))
    high = rows.select("fp", "band", others.alias("first"), F.col("deal").alias("second"), F.col("id").alias("high"), F.col("len").alias("len_high"))
    high = high.withColumn("cell", F.explode(F.array("band", F.col("band") - 1) if width else F.array("band")))
    met = low.join(high, ["fp", "cell", "first", "second"]).filter((F.col("band") > F.col("cell")) | (F.col("low") < F.col("high")))
    swap = F.col("low") > F.col("high")
    lengths = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(c) for c, x, y in (("len_a", "len_high", "len_low"), ("len_b", "len_low", "len_high"))]
    return met.select(F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b"), *lengths).filter(allowed)


def shared_windows(kept: DataFrame, ratio: float | None = None, allowed: Column | None = None, most: int = 4096) -> DataFrame:
    """(a, b, len_a, len_b, shared) of class pairs with windows in common; a = b for classes of several blocks.

    ``allowed`` is a condition on len_a and len_b, either way round, that pairs of
    other lengths fail while they are joined, before they are counted; it must imply
    the length ratio ``ratio``. Windows of more than ``most`` classes are divided.
    """
    allowed = F.lit(True) if allowed is None else allowed
    met, hot = _common(kept.filter(F.col("classes") <= most), allowed), kept.filter(F.col("classes") > most)
    if not hot.isEmpty():
        met = met.unionByName(_common_hot(hot, allowed, ratio, most))
    across = met.groupBy("a", "b", "len_a", "len_b").agg(F.count("*").alias("shared"))
    within = kept.filter("n > 1").groupBy(F.col("class_id").alias("a"), F.col("len").alias("len_a")).agg(F.count("*").alias("shared"))
    return across.unionByName(within.select("a", F.col("a").alias("b"), "len_a", F.col("len_a").alias("len_b"), "shared"))


def _ratio_ok(threshold: float) -> Column:
    a, b = F.col("len_a"), F.col("len_b")
    return (a > 0) & (b > 0) & (2.0 * F.least(a, b) / (a + b) >= threshold)


def bag_counts(classes: DataFrame) -> DataFrame:
    """(class_id, id, c): how often each id occurs in each class."""
    return classes.select("class_id", F.explode("struct_ids").alias("id")).groupBy("class_id", "id").agg(F.count("*").alias("c"))


def bag_overlaps(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b, len_a, len_b, shared) with ``common``, the size of their common multiset of ids, where it isn't empty.

    A class's bag is made once, as the set of its ids numbered by occurrence, so that
    a pair costs one intersection of sets.
    """
    kept = pairs.filter("a < b")
    used = kept.select(F.col("a").alias("class_id")).union(kept.select("b")).distinct()
    numbered = F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1).cast("long"), "c"), lambda k: F.xxhash64("id", k))))
    bags = materialize(bag_counts(classes.join(used, "class_id", "left_semi")).groupBy("class_id").agg(numbered.alias("bag")), "bags")
    side = lambda s: bags.select(F.col("class_id").alias(s), F.col("bag").alias(f"bag_{s}"))
    keys = ["a", "b", "len_a", "len_b", "shared"]
    common = F.size(F.array_intersect("bag_a", "bag_b")).cast("bigint")
    across = kept.join(side("a"), "a").join(side("b"), "b").select(*keys, common.alias("common")).filter("common > 0")
    return across.unionByName(pairs.filter("a = b").select(*keys, F.col("len_a").alias("common")))


def detect_clones(blocks: DataFrame, cfg: DetectConfig = DetectConfig()) -> Detection:
    """Similar blocks among ``blocks`` (block_id, struct_ids and, for text, text_ids: arrays of BIGINT)."""
    if "text_ids" not in blocks.columns:
        blocks = blocks.withColumn("text_ids", F.lit(None).cast("array<bigint>"))
    classes, members = content_classes(blocks)
    n = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    prints = materialize(fingerprints(classes, cfg.window), "windows")
    pairs = shared_windows(materialize(capped(prints, frequency_cap(n)), "capped"), cfg.threshold, _ratio_ok(cfg.threshold)).filter(F.col("shared") >= cfg.min_shared)
    least = C.least_shared(F.col("len_a"), F.col("len_b"), cfg.window, cfg.min_shared, cfg.threshold)
    pairs = materialize(pairs.filter((F.col("shared") >= least) & _ratio_ok(cfg.threshold)), "pairs")
    texts = "text_ids" if cfg.text_weight > 0 else None
    side = lambda s: classes.select(F.col("class_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("struct_ids").alias(f"s_{s}"), (F.col(texts) if texts else F.lit(None).cast("array<bigint>")).alias(f"t_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    similarity = blended_udf(cfg.text_weight, cfg.threshold, cfg.mode, bound=True)("s_a", "s_b", "t_a", "t_b")
    scored = both.filter("a < b").withColumn("similarity", similarity).unionByName(both.filter("a = b").withColumn("similarity", F.lit(1.0)))
    scored = scored.filter((F.col("similarity") >= cfg.threshold) & (F.col("similarity") >= 0))
    weight = F.when(F.col("a") == F.col("b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("bigint")
    pairs = materialize(scored.select("a", "b", "shared", "similarity", weight.alias("weight")), "similar")
    groups, averages = group_pairs(pairs, members)
    return Detection(classes, members, pairs, groups, averages)


def group_pairs(pairs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connected blocks, and each group's size and mean similarity over its accepted pairs of blocks."""
    ends = pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct()
    linked = connected_components(pairs, "a", "b")
    labels = materialize(ends.join(linked, "vertex", "left").select(F.col("vertex").alias("class_id"), F.coalesce("component", "vertex").alias("group_id")), "labels")
    groups = materialize(members.join(labels, "class_id").select("block_id", "group_id"), "groups")
    sums = pairs.join(labels, pairs["a"] == labels["class_id"]).groupBy("group_id").agg((F.sum(F.col("similarity") * F.col("weight")) / F.sum("weight")).alias("avg_similarity"))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size"), F.min("block_id").alias("first_block"))
    return groups, materialize(sizes.join(sums, "group_id"), "averages")


def expand_pairs(found: Detection) -> DataFrame:
    """(a, b, similarity) for every accepted pair of blocks, a < b."""
    side = lambda s: found.members.select(F.col("block_id").alias(f"block_{s}"), F.col("class_id").alias(s))
    both = found.pairs.join(side("a"), "a").join(side("b"), "b").filter("a < b or block_a < block_b")
    return both.select(F.least("block_a", "block_b").alias("a"), F.greatest("block_a", "block_b").alias("b"), "similarity")


def ranked_groups(averages: DataFrame) -> DataFrame:
    """Groups by size, then mean similarity, then first block."""
    return averages.orderBy(F.desc("size"), F.desc("avg_similarity"), "first_block")
