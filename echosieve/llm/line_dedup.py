"""Dedup of lines across documents with levelled sorted runs of line hashes.

Lines are hashed once and dealt to batches by descending document id. Batches are
fed to a store of runs: a run holds line hashes with the number of its documents
that have the line, and the largest of their ids. Each new batch is merge-anti-joined with the runs
there are. A line that no run holds is fresh: its last document is in this batch,
as all later ones have smaller ids, and the batch's run names it. A line that some
run holds only adds its documents to the count. So every line has one fresh row in
all runs, which says where it stays.

A level is one bucketed table, sorted by hash within buckets; its runs are files of
the same buckets. When a level has ``fanout`` runs, it is merged into one run of the
next level; at the end all levels are. Built from DataFrame operations only: a batch
is shuffled once, and neither the joins nor the merges shuffle a run. A very common
line is counted with map-side pre-aggregation and joined where adaptive execution
may split it.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends,
with A-Z lower-cased; keys are told apart by two 64-bit hashes.

Defined results: null or empty text is one empty line. Rows with the same id are
one document for the counts; if several hold a key and the id is the largest,
all keep it. A null id is a document that is never the largest. Repeated rows
are returned each time. Other columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echosieve.llm.common import LOWER, UPPER, as_row, of_row, same
from echosieve.storage import Scratch, discard, materialize, scratch_path, tidy

_BLANKS = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() serves where no other character would change."""
    return F.when(text.rlike(r"[\P{ASCII}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(_BLANKS))


class LineRuns:
    """Levels of sorted runs (h1, h2, docs, last, fresh); a context that forgets its tables at the end."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: table, path and number of runs of each level
        self.levels: list[tuple[str, str, int]] = []

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_: object) -> None:
        for depth in range(len(self.levels)):
            self._clear(depth)

    def _append(self, depth: int, run: DataFrame) -> None:
        while len(self.levels) <= depth:
            self.levels.append((f"echosieve_runs_{uuid.uuid4().hex}", scratch_path(self.spark, "runs"), 0))
        name, path, runs = self.levels[depth]
        rows = run.select("h1", "h2", "docs", "last", "fresh").write.mode("append").format("parquet")
        with tidy(self.spark):
            rows.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.levels[depth] = name, path, runs + 1

    def _clear(self, depth: int) -> None:
        name, path, _ = self.levels[depth]
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(path)
        self.levels[depth] = f"echosieve_runs_{uuid.uuid4().hex}", scratch_path(self.spark, "runs"), 0

    def _up(self, depth: int) -> None:
        """One run of the next level from all of a level's."""
        self._append(depth + 1, self.compacted(depth))
        self._clear(depth)

    def level(self, depth: int) -> DataFrame:
        return self.spark.table(self.levels[depth][0])

    def held(self) -> list[int]:
        """The levels that have runs."""
        return [depth for depth, (_, _, runs) in enumerate(self.levels) if runs]

    def runs(self) -> int:
        return sum(runs for _, _, runs in self.levels)

    def compacted(self, depth: int) -> DataFrame:
        return self.level(depth).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"), F.max("fresh").alias("fresh"))

    def told(self, batch: DataFrame) -> DataFrame:
        """(h1, h2, docs, last), one row for each key, with ``fresh`` where no run has the key; only there ``last`` stays."""
        fresh = F.lit(True)
        for depth in self.held():
            known = self.level(depth).filter("fresh").select("h1", "h2", F.lit(True).alias(f"in{depth}")).hint("merge")
            batch = batch.join(known, ["h1", "h2"], "left")
            fresh = fresh & F.col(f"in{depth}").isNull()
        return batch.select("h1", "h2", "docs", F.when(fresh, F.col("last")).alias("last"), fresh.alias("fresh"))

    def add(self, batch: DataFrame) -> None:
        """Take in a batch (h1, h2, docs, last), whose ids are below those of all batches before."""
        self._append(0, self.told(batch))
        depth = 0
        while self.levels[depth][2] >= self.fanout:
            self._up(depth)
            depth += 1

    def merged(self) -> DataFrame:
        """One row for each key of all runs, which become one."""
        while self.runs() > 1:
            self._up(self.held()[0])
        return self.level(self.held()[0]) if self.levels else self.spark.createDataFrame([], "h1 long, h2 long, docs long, last long, fresh boolean")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """(doc_id, text_hash, n_dropped, mask) of documents that lose lines; mask is true at their places.

    Without ``batches`` there is one for each 2 GB of text, at least 4 and at most 32, so that sorting a large corpus
    takes few passes; batches are ranges of ids, of any size.
    """
    with Scratch() as own:
        found, kept = _dropped(docs, min_chars, min_docs, batches, fanout)
        own.release(*kept)
    return found


def _dropped(docs: DataFrame, min_chars: int, min_docs: int, batches: int | None, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """What dropped_lines returns, and the tables that it scans."""
    spark = docs.sparkSession
    shape = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("doc_id", [k / 32 for k in range(1, 32)], 1000).alias("cuts")).first()
    many = batches or min(32, max(4, (shape.bytes or 0) >> 31))
    cuts = sorted({shape.cuts[k * 32 // many - 1] for k in range(1, min(many, 32))}) if shape.cuts else []
    number = F.lit(len(cuts) + 1)  # null ids come last
    if cuts:
        number = F.when(F.col("doc_id") <= cuts[0], len(cuts)).otherwise(number)
        for k, cut in enumerate(cuts):
            number = F.when(F.col("doc_id") > cut, len(cuts) - 1 - k).otherwise(number)
    else:
        number = F.when(F.col("doc_id").isNotNull(), 0).otherwise(number)
    line = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n"))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), line.alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), number.cast("int").alias("batch"))
    lines = materialize(lines, "lines", part="batch")
    with LineRuns(spark, fanout) as store:
        for i in range(len(cuts) + 2):
            one = lines.filter(F.col("batch") == i).groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
            store.add(one.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))
        common = materialize(store.merged().filter(F.col("docs") >= min_docs).select("h1", "h2", "last"), "common-lines")
    gone = lines.join(common, ["h1", "h2"]).filter(~same(F.col("doc_id"), F.col("last"))).select("doc_id", "text_hash", "pos").distinct()
    own = Window.partitionBy("doc_id", "text_hash").orderBy("pos")
    gap = F.col("pos") - F.coalesce(F.lag("pos").over(own), F.lit(-1)) - 1
    pieces = gone.withColumn("gap", gap).select("doc_id", "text_hash", F.struct("pos", F.concat(F.array_repeat(F.lit(False), F.col("gap")), F.array(F.lit(True))).alias("piece")).alias("x"))
    each = pieces.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_dropped"), F.array_sort(F.collect_list("x")).alias("xs"))
    return each.select("doc_id", "text_hash", "n_dropped", F.flatten(F.transform("xs", lambda x: x["piece"])).alias("mask")), [lines, common]


def drop_common_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``), ``text`` without its common lines, and ``es_n_lines`` and ``es_n_dropped``.

    A document that loses all its lines keeps an empty text.
    """
    gone = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout).select(
        F.col("doc_id").alias("es_id"), F.col("text_hash").alias("es_hash"), F.col("n_dropped").alias("es_n"), F.col("mask").alias("es_mask")
    )
    text = F.coalesce("text", F.lit(""))
    others = [c for c in docs.columns if c not in ("text", "es_n_lines", "es_n_dropped")]
    rows = docs.select(as_row(others), "text", F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    joined = rows.join(gone, same(F.col("id"), F.col("es_id")) & (F.col("hash") == F.col("es_hash")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get(F.col("es_mask"), i), F.lit(False))), "\n")
    return joined.select(
        *of_row(others), F.when(F.col("es_n").isNull(), text).otherwise(kept).alias("text"), F.size(F.split(text, "\n")).cast("long").alias("es_n_lines"), F.coalesce("es_n", F.lit(0)).cast("long").alias("es_n_dropped")
    )
