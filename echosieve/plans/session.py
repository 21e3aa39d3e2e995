"""An analysis of a directory and the questions asked of it.

Tokens are written once; a change of settings starts again from there. Every
answer is a DataFrame, and stays distributed until a report collects it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.config import AnalysisConfig, DetectConfig, IntraConfig, Scope
from echosieve.functions import columns as C
from echosieve.operators.blocks import extract_blocks, tokenize
from echosieve.operators.detect import detect_clones
from echosieve.operators.intra import detect_intra
from echosieve.operators.numbering import number_rows
from echosieve.operators.scope import categorize_changed, changed_blocks, filter_changed, filter_scope, within_and_across
from echosieve.sources.diff import diff_lines, git_diff, parse_diff
from echosieve.sources.encoding import parse_encoding, to_utf8_col
from echosieve.sources.files import git_root, scan_files
from echosieve.storage import Scratch, materialize


class Session:
    """Blocks, groups and repeated regions of one directory."""

    def __init__(self, spark: SparkSession, config: AnalysisConfig):
        self.spark, self._scratch = spark, Scratch()
        #: seconds of each step of the last analysis
        self.timings: dict[str, float] = {}
        self.analyze(config)

    def close(self) -> None:
        """Delete the session's tables; its answers must not be used any more."""
        self._scratch.close()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @contextmanager
    def _timed(self, step: str) -> Iterator[None]:
        began = perf_counter()
        yield
        self.timings[step] = perf_counter() - began

    # --- analysis ---------------------------------------------------------

    def analyze(self, config: AnalysisConfig) -> Session:
        self.config = config
        self._scratch.close()
        with self._scratch, Scratch() as own:
            files = scan_files(self.spark, config.root, list(config.extensions) or None, list(config.globs) or None, config.respect_ignore)
            content = to_utf8_col(F.col("content"), parse_encoding(config.encoding))
            with self._timed("scanning"):
                self.files = materialize(files.withColumn("content", content), "files")
            with self._timed("tokenizing"):
                self.tokens = materialize(tokenize(self.files, "utf-8"), "tokens")
            own.release(self.files, self.tokens)
        return self._detect()

    def reconfigure(self, **changes) -> Session:
        """Other settings on the same tokens."""
        self.config = replace(self.config, **changes)
        return self._detect()

    def _detect(self) -> Session:
        with self._scratch, Scratch() as own:
            self._search()
            own.release(self.blocks, self._members, self._intra, self._groups)
        return self

    def _search(self) -> None:
        c = self.config
        with self._timed("normalizing"):
            self.blocks = materialize(extract_blocks(self.tokens, c.min_tokens), "blocks")
        narrow = self.blocks.select("block_id", "struct_ids", "text_ids")
        with self._timed("cloneDetection"):
            if c.scope & Scope.INTER_FUNCTION:
                found = detect_clones(narrow, DetectConfig(threshold=c.threshold, text_weight=c.text_weight, mode=c.mode))
                scoped = filter_scope(found.groups, self.blocks.select("block_id", "file_id"), c.scope)
                averages = found.averages.select("group_id", "avg_similarity")
            else:
                scoped = self.spark.createDataFrame([], "group_id long, file_id int, block_id long")
                averages = self.spark.createDataFrame([], "group_id long, avg_similarity double")
            self._members = materialize(scoped.join(averages, "group_id"), "scoped")
        with self._timed("intraDetection"):
            if c.scope & Scope.INTRA_FUNCTION:
                found_intra = detect_intra(narrow, IntraConfig(min_region=c.min_tokens, threshold=c.threshold, text_weight=c.text_weight))
            else:
                found_intra = self.spark.createDataFrame([], "block_id long, pairs array<struct<a_start:int,a_len:int,b_start:int,b_len:int,similarity:double>>")
            self._intra = materialize(found_intra, "intra")
        self._rank()

    def _rank(self) -> None:
        """Groups by the raw length of their first block; members in the order of blocks."""
        size = self.blocks.select("block_id", (F.col("token_end") - F.col("token_start")).alias("raw"))
        heads = self._members.groupBy("group_id", "file_id").agg(F.min("block_id").alias("block_id"), F.count("*").alias("size"), F.first("avg_similarity").alias("avg_similarity"))
        ranked = heads.join(size, "block_id").select("group_id", "file_id", F.col("block_id").alias("first_block"), "size", "avg_similarity", "raw")
        self._groups = materialize(number_rows(ranked, [F.desc("raw"), F.desc("size"), F.asc("first_block")], "group_index"), "groups")

    def restrict_to_diff(self, base: str, source: str = "HEAD") -> bool:
        """Keep the groups and regions that touch lines changed since ``base``; False if nothing relevant changed."""
        changes = self.changes(base, source)
        if changes.isEmpty():
            return False
        changed = changed_blocks(self.blocks.select("block_id", "path", "start_line", "end_line"), changes).select("block_id")
        with self._scratch, Scratch() as own:
            changed = materialize(changed, "changed")
            self._members = materialize(filter_changed(self._members, changed), "scoped")
            self._intra = materialize(self._intra.join(changed, "block_id", "left_semi"), "intra")
            self._rank()
            own.release(self._members, self._intra, self._groups)
        return True

    def changes(self, base: str, source: str = "HEAD") -> DataFrame:
        """(path, start_line, end_line) of a diff; paths count from the repository's root."""
        root = git_root(self.config.root) or self.config.root
        lines = diff_lines(self.spark, git_diff(root, base, source))
        globs = list(self.config.globs)
        ranges = parse_diff(lines, None if globs else [e for e in self._extensions()])
        if globs:
            ranges = ranges.filter(C.glob_match(C.file_name(F.col("path")), globs))
        return ranges.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), "start_line", "end_line")

    def _extensions(self) -> list[str]:
        from echosieve.languages.registry import code_extensions

        return list(self.config.extensions) or code_extensions()

    # --- answers ------------------------------------------------------------

    def members(self) -> DataFrame:
        """(group_index, block_id, name, path, start_line, start_col, end_line, end_col, avg_similarity) of all groups."""
        keys = self._groups.select("group_index", F.col("group_id").alias("g"), F.col("file_id").alias("f"), "size")
        rows = self._members.join(keys, (F.col("group_id") == F.col("g")) & F.col("file_id").eqNullSafe(F.col("f")))
        return rows.select("group_index", "size", "avg_similarity", "block_id").join(self.blocks.select("block_id", "name", "path", "start_line", "start_col", "end_line", "end_col", "token_start", "token_end"), "block_id")

    def clone_groups(self, limit: int = 20, offset: int = 0, min_similarity: float = 0.0, path_part: str = "", source: bool = False) -> DataFrame:
        """A page of groups, each with its blocks, with their source lines if asked for; ``group_index`` is the place among all groups."""
        rows = self.members()
        if source:
            text = self.files.select("path", F.col("content").cast("string").alias("text"))
            rows = rows.join(text, "path").withColumn("source", C.source_lines(F.col("text"), F.col("start_line"), F.col("end_line"))).drop("text")
        block = F.struct("block_id", "name", "path", "start_line", "start_col", "end_line", "end_col", *(["source"] if source else []))
        rows = rows.groupBy("group_index", "size", "avg_similarity").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
        rows = rows.filter(F.col("avg_similarity") >= min_similarity)
        if path_part:
            rows = rows.filter(F.exists("blocks", lambda b: b["path"].contains(path_part)))
        return rows.orderBy("group_index").offset(offset).limit(limit)

    def intra_regions(self) -> DataFrame:
        """Blocks with repeated regions, those with the longest first."""
        longest = F.array_max(F.transform("pairs", lambda p: F.greatest(p["a_len"], p["b_len"])))
        return self._intra.withColumn("longest", longest).join(self.blocks.drop("struct_ids", "text_ids"), "block_id").orderBy(F.desc("longest"), "block_id")

    def code_block(self, block_id: int) -> DataFrame:
        """A block with its source lines."""
        row = self.blocks.filter(F.col("block_id") == block_id).drop("struct_ids", "text_ids")
        text = self.files.select("file_id", F.col("content").cast("string").alias("text"))
        return row.join(text, "file_id").withColumn("source", C.source_lines(F.col("text"), F.col("start_line"), F.col("end_line"))).drop("text")

    def file_duplicates(self, path_part: str, limit: int = 0) -> DataFrame:
        """Groups with a block in a file whose path holds ``path_part``."""
        return self.clone_groups(limit or (1 << 31) - 1, 0, 0.0, path_part)

    def analyze_file(self, path: str, limit: int = 0) -> DataFrame:
        """(category, rank, group_index, size, avg_similarity): the groups of one file, within it and across files."""
        rows = self.files.filter(F.col("path") == path).select("file_id").take(1)
        if not rows:
            raise FileNotFoundError(path)
        named = self.members().select(F.col("group_index").alias("group_id"), "block_id")
        return self._by_category(within_and_across(named, self.blocks, rows[0].file_id), limit)

    def branch_duplicates(self, base: str, source: str = "HEAD", limit: int = 0) -> DataFrame:
        """Groups that a branch adds to: ``existing`` code copied, or ``new`` code only."""
        changed = changed_blocks(self.blocks.select("block_id", "path", "start_line", "end_line"), self.changes(base, source))
        named = self.members().select(F.col("group_index").alias("group_id"), "block_id")
        return self._by_category(categorize_changed(named, changed), limit)

    def _by_category(self, categories: DataFrame, limit: int) -> DataFrame:
        from echosieve.operators.scope import top_each

        rows = categories.withColumnRenamed("group_id", "group_index").join(self._groups.select("group_index", "size", "avg_similarity"), "group_index")
        return top_each(rows, "category", ["group_index"], limit)

    def summary(self) -> DataFrame:
        """One row: files, blocks, groups, blocks in groups, lines in groups, functions and pairs of repeated regions."""
        lines = F.sum(F.col("end_line") - F.col("start_line") + 1)
        grouped = self.members().agg(F.countDistinct("group_index").alias("groups"), F.count("*").alias("duplicated_functions"), F.coalesce(lines, F.lit(0)).alias("duplicated_lines"))
        intra = self._intra.agg(F.count("*").alias("intra_functions"), F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("intra_pairs"))
        files = self.files.agg(F.count("*").alias("files"))
        blocks = self.blocks.agg(F.count("*").alias("blocks"))
        return files.crossJoin(blocks).crossJoin(grouped).crossJoin(intra)  # one row each

    def errors(self) -> DataFrame:
        """Files that couldn't be tokenized."""
        return self.tokens.filter("error is not null").select("path", "error.*")
