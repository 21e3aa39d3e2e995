"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts; ``bytes.split()`` splits at exactly these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + column.replace("`", "``") + "`")


def as_row(columns: list[str]) -> Column:
    """The columns as one struct ``row``, so that none of their names can clash with an operator's own."""
    return (F.struct(*map(named, columns)) if columns else F.struct(F.lit(None).cast("int").alias("none"))).alias("row")


def of_row(columns: list[str]) -> list[Column]:
    """The columns back from ``row``; ``text`` is always kept beside it."""
    return [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns]


def vocabulary_file(vocabulary: str) -> str:
    """A vocabulary's file on the machine that asks: a path, or the name of a public tokenizer's file."""
    if Path(vocabulary).exists():
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


def id_remainder(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def decoded(column: pa.Array) -> list[str | None]:
    """The texts; bytes that aren't valid UTF-8 become replacement characters."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()]


def as_strings(texts: list[bytes]) -> pa.Array:
    """Texts as a string column; bytes that aren't valid UTF-8 stay as they are."""
    return pa.array(texts, pa.binary()).view(pa.string())


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


class _Hashes(dict):
    """Hash of a word, kept for repeated words; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(parts: list[list[bytes]], total: int) -> np.ndarray:
    """64-bit hashes of the words of all texts, one after the other."""
    return np.fromiter(map(_hashes.__getitem__, chain.from_iterable(parts)), np.uint64, total)
