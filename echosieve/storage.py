"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; the files
survive the loss of any executor and are read back with their known schema.

Every table belongs to the innermost open ``Scratch``, or to the process, whose
tables go at its end, even if the session ended before. The shuffle files behind
a table go as soon as it is written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="echosieve-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """The owner of the tables that are written while it is open; they stay until it is closed or releases them."""

    def __init__(self) -> None:
        #: path -> how to delete it; needs no session
        self.paths: dict[str, tuple] = {}

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *failed: object) -> None:
        _open.remove(self)
        if failed[0] is not None:
            self.close()

    def add(self, spark: SparkSession, path: str) -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.paths[path] = (place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place)

    def delete(self, path: str) -> None:
        system, place = self.paths.pop(path)
        with suppress(Exception):  # the JVM may have ended
            system.delete(place, True)

    def release(self, *kept: DataFrame) -> None:
        """Delete the tables but those that ``kept`` scan, which go to the owner around this one. Frames that read others must not be used any more."""
        scanned = {_path_of.get(df) for df in kept}
        around = _open[max(0, _open.index(self) - 1)] if self in _open else _process
        for path in [*self.paths]:
            if path not in scanned:
                self.delete(path)
            elif around is not self:
                around.paths[path] = self.paths.pop(path)

    def close(self) -> None:
        for path in [*self.paths]:
            self.delete(path)


_process = Scratch()
_open: list[Scratch] = [_process]
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/echosieve-{name}-{uuid.uuid4().hex}"
    _open[-1].add(spark, path)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are removed when it ends; its result is in a table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str, part: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of what was written; a filter by the column ``part`` (the last one) reads that part alone."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        (df.write.partitionBy(part) if part else df.write).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """Write ``df`` in ``buckets`` files by the hash of ``by``; the scan returned is grouped or joined by it without a shuffle.

    The catalog's entry is only needed to tell the scan of the buckets and is dropped at once; the files are scratch.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"echosieve_{uuid.uuid4().hex}"
    try:
        with tidy(spark):
            df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
        out = spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    _path_of[out] = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Delete the tables, given as frames that scan them or as paths, whoever owns them."""
    for table in tables:
        path = table if isinstance(table, str) else _path_of.get(table)
        for owner in _open:
            if path in owner.paths:
                owner.delete(path)


atexit.register(_process.close)
