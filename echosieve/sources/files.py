"""Source files as rows."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.functions import columns as C
from echosieve.languages import registry
from echosieve.operators.numbering import attach_numbers


def glob_matches(pattern: str, name: str) -> bool:
    """Whether a whole name matches a glob of * and ?."""
    import re

    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), name, re.DOTALL) is not None


def _hadoop_glob(patterns: list[str], any_case: bool = False) -> str:
    """One glob of the file system for all patterns, in which only * and ? have a meaning."""

    def part(c: str) -> str:
        if any_case and c.isalpha():
            return f"[{c.lower()}{c.upper()}]"
        return f"\\{c}" if c in "[]{},\\" else c

    return "{" + ",".join("".join(map(part, p)) for p in patterns) + "}"


def scan_files(spark: SparkSession, root: str, extensions: list[str] | None = None, globs: list[str] | None = None, respect_ignore: bool = False) -> DataFrame:
    """(file_id, path, language, content) of the files below ``root``, numbered by path.

    ``globs`` on the file name take the place of the extensions; an empty list
    of extensions takes every file. Files are chosen by path before any is read.
    """
    if "://" not in root and not Path(root).is_dir():
        raise NotADirectoryError(root)
    wanted = registry.code_extensions() if extensions is None else [e.lower() for e in extensions]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if globs or wanted:
        reader = reader.option("pathGlobFilter", _hadoop_glob(globs) if globs else _hadoop_glob([f"*{e}" for e in wanted], True))
    clean = F.regexp_replace("path", "^file:/+", "/")
    rows = reader.load(root).select(clean.alias("path"), "content")
    if globs:
        rows = rows.filter(C.glob_match(C.file_name(F.col("path")), globs))
    elif wanted:
        rows = rows.filter(C.extension(F.col("path")).isin(wanted))
    if respect_ignore and (kept := non_ignored_files(root)) is not None:
        known = spark.createDataFrame([(p,) for p in kept], "path string")
        rows = rows.join(known, "path", "left_semi")
    language = F.lit(None).cast("string")
    for spec in registry.languages():
        language = F.coalesce(language, F.when(C.extension(F.col("path")).isin(*spec.extensions), F.lit(spec.name)))
    numbered = attach_numbers(rows.select("path", language.alias("language"), "content"), ["path"], ["path"], "file_id")
    return numbered.select(F.col("file_id").cast("int").alias("file_id"), "path", "language", "content")


def git_root(path: str) -> str | None:
    done = subprocess.run(["git", "-C", path, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


def non_ignored_files(path: str) -> list[str] | None:
    """Files that version control knows or would take, as absolute paths; None outside a repository."""
    root = git_root(path)
    if root is None:
        return None
    done = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True)
    return [str((Path(root) / n.decode()).resolve()) for n in done.stdout.split(b"\0") if n] if done.returncode == 0 else None
