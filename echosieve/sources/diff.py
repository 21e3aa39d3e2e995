"""Changed lines from unified diffs."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echosieve.functions import columns as C


def git_diff(root: str, base: str, source: str = "HEAD") -> str:
    """The diff without context from the fork point of ``base`` to ``source``."""
    done = subprocess.run(["git", "-C", root, "diff", "--no-color", "-U0", f"{base}...{source}", "--"], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(done.stdout + done.stderr)
    return done.stdout


def diff_lines(spark: SparkSession, text: str) -> DataFrame:
    """(diff_id, pos, line) of one diff."""
    return spark.createDataFrame([(0, text)], "diff_id int, text string").select("diff_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def parse_diff(lines: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """(diff_id, pos, path, start_line, end_line) of the changed ranges in (diff_id, pos, line).

    Files are those after the last " b/" of their header; deleted, binary and
    other files than ``extensions`` are left out, as are hunks without new lines
    or with a malformed head.
    """
    header = F.col("line").startswith("diff --git ")
    start = F.when(header, F.struct(F.regexp_extract("line", r"^diff --git .* b/(.*)$", 1).alias("path")))
    stop = F.col("line").startswith("+++ /dev/null") | F.col("line").startswith("Binary files ")
    so_far = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("path", F.last(start, ignorenulls=True).over(so_far)["path"]).withColumn("file_no", F.sum(header.cast("int")).over(so_far))
    rows = rows.withColumn("stopped", F.max(stop).over(Window.partitionBy("diff_id", "file_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    head = r"^@@ -\S+ \+(\d+)(?:,(\d+))?[ @]"
    hunks = rows.filter(F.col("line").rlike(head) & ~F.col("stopped") & F.coalesce(F.col("path") != "", F.lit(False)))
    first = F.regexp_extract("line", head, 1).try_cast("int")
    length = F.regexp_extract("line", head, 2)
    count = F.when(length == "", 1).otherwise(length.try_cast("int"))
    hunks = hunks.select("diff_id", "pos", "path", first.alias("start_line"), (first + count - 1).alias("end_line")).filter(F.col("end_line") >= F.col("start_line"))
    if extensions:
        hunks = hunks.filter(C.extension(F.col("path")).isin([e.lower() for e in extensions]))
    return hunks
