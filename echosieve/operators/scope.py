"""Restriction of groups to files, to changed lines, and their division by both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echosieve.config import Scope
from echosieve.functions import columns as C


def filter_scope(groups: DataFrame, files: DataFrame, scope: Scope) -> DataFrame:
    """(group_id, file_id, block_id) of the groups (block_id, group_id) that a scope keeps.

    files: (block_id, file_id). Across files: groups of two files at least, as
    they are, with a null file_id. Within files: a group is divided by file and
    parts of two blocks stay, each still named by its group.
    """
    want = scope & Scope.INTER_FUNCTION
    if want == Scope.INTER_FUNCTION or not want:
        rows = groups.select("group_id", F.lit(None).cast(files.schema["file_id"].dataType).alias("file_id"), "block_id")
        return rows if want else rows.limit(0)
    rows = groups.join(files.select("block_id", "file_id"), "block_id").select("group_id", "file_id", "block_id")
    if want == Scope.INTER_FILE:
        # two files at least: the least and the greatest differ
        several = rows.groupBy("group_id").agg(F.min("file_id").alias("x"), F.max("file_id").alias("y")).filter("x <> y").select("group_id")
        return rows.join(several, "group_id", "left_semi").withColumn("file_id", F.lit(None).cast(files.schema["file_id"].dataType))
    several = rows.groupBy("group_id", "file_id").count().filter("count >= 2").select("group_id", "file_id")
    return rows.join(several, ["group_id", "file_id"], "left_semi")


def changed_blocks(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Blocks (path, start_line, end_line, ...) that meet a changed range (path, start_line, end_line)."""
    c = changes.select(F.col("path").alias("c_path"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    on = (F.col("path") == F.col("c_path")) & C.lines_overlap(F.col("c_start"), F.col("c_end"), F.col("start_line"), F.col("end_line"))
    return blocks.join(c, on, "left_semi")


def filter_changed(groups: DataFrame, changed: DataFrame) -> DataFrame:
    """Groups (block_id, group_id) with a block in ``changed`` (block_id), whole."""
    hit = groups.join(changed.select("block_id"), "block_id", "left_semi").select("group_id").distinct()
    return groups.join(hit, "group_id", "left_semi")


def categorize_changed(groups: DataFrame, changed: DataFrame) -> DataFrame:
    """(group_id, category): ``existing`` for groups with changed and unchanged blocks, ``new`` for those with changed ones only."""
    flagged = groups.join(changed.select("block_id", F.lit(True).alias("changed")), "block_id", "left")
    both = flagged.groupBy("group_id").agg(F.count("changed").alias("changed"), F.count("*").alias("size"))
    return both.filter("changed > 0").select("group_id", F.when(F.col("changed") < F.col("size"), "existing").otherwise("new").alias("category"))


def within_and_across(groups: DataFrame, files: DataFrame, file_id) -> DataFrame:
    """(group_id, category) for a file's groups: ``within`` if two of its blocks are in the group, ``cross`` if blocks of other files are; both are possible."""
    rows = groups.join(files.select("block_id", "file_id"), "block_id")
    own = F.count(F.when(F.col("file_id") == file_id, 1)).alias("own")
    counts = rows.groupBy("group_id").agg(own, F.count("*").alias("size")).filter("own > 0")
    kinds = F.array(F.when(F.col("own") >= 2, F.lit("within")), F.when(F.col("own") < F.col("size"), F.lit("cross")))
    return counts.select("group_id", F.explode(F.array_compact(kinds)).alias("category"))


def top_each(df: DataFrame, category: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each category (0: all)."""
    from pyspark.sql.window import Window

    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(*order)))
    return ranked if limit == 0 else ranked.filter(F.col("rank") <= limit)
