"""Consecutive numbers for the rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echosieve.storage import materialize


def number_rows(df: DataFrame, order: list[str] | list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... by the columns ``order``.

    Rows are sorted by ranges, numbered within their partition, and shifted by
    the sizes of the partitions before; no row passes through a single task. Ranges
    come from a sample, for which ``df`` is computed a second time, and rows move as
    they are: number narrow rows of a table, and join the rest by ``attach_numbers``.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = materialize(parts.select("*", F.spark_partition_id().alias("es_part"), local.alias("es_local")), "numbered")
    sizes = parts.groupBy("es_part").count()
    before = sizes.select("es_part", (F.sum("count").over(Window.orderBy("es_part")) - F.col("count")).alias("es_before"))
    return parts.join(F.broadcast(before), "es_part").withColumn(name, F.col("es_before") + F.col("es_local")).drop("es_part", "es_local", "es_before")


def attach_numbers(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """``df``, a table or a scan, with ``name``: 0, 1, 2, ... by the columns ``order``. The columns ``key`` tell its rows apart; only they and ``order`` are sorted."""
    narrow = df.select(*dict.fromkeys([*key, *order]))
    return df.join(materialize(number_rows(narrow, order, name).select(*key, name), "numbers"), key)
