"""Mixing of sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) get the weights in turn; a share
of all sizes is split by weight, and no target exceeds ``most`` times its
source's size: the excess goes to the others by weight, found in closed form
from the sources sorted by size over weight. Each source also has a schedule,
its relative rate at given points of training, linear between them. The integral
of the schedule, scaled to the target, is the source's cumulative demand over
time. Documents of a source follow each other in the order of a hash of their
id, pass after pass; the place of a document's middle word in that order is
looked up in the inverse demand, which gives its training position in [0, 1).
The mix is the documents range-sorted by position.

Built from DataFrame operations only. Places within a source come from sums over
hash ranges and a window within each range, so no source is gathered in one task.

``taken`` of a document is the number of its words the mix takes, at most
``most`` (2) times its size. At most one document of a source and pass is cut.
Targets are met to the word. Defined results: null or empty text has size 0 and
is not in the mix. Repeated rows are separate documents; ties in the hash go by
id, size and text. The order is fixed by the rows alone, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echosieve.llm.common import WORD, as_row, of_row, same, words
from echosieve.storage import materialize

WEIGHTS = (3, 1, 2)
#: Points of training and, taking turns among the sources, the relative rates there.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))
#: Documents that one hash range of all sources should hold at most, about.
RANGE_ROWS = 4096


def targets(sizes: DataFrame, percent: int = 150, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """(source, source_size, place, weight, target) from (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    cap = (most * F.col("source_size")).alias("cap")
    per = per.select("*", cap).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    upto = rising.rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("cap_sum", F.sum("cap").over(upto)).withColumn("weight_left", F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(upto))
    # the demand at the level where a source fills up, against the total to share: both times 100 weight
    full = 100 * (F.col("cap_sum") * F.col("weight") + F.col("cap") * F.col("weight_left")) <= percent * F.col("all") * F.col("weight")
    per = per.withColumn("full", full)
    total = Window.partitionBy()
    per = per.withColumn("full_cap", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(total)).withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(total))
    rest = (F.col("weight") * (percent * F.col("all") - 100 * F.col("full_cap"))).cast("double") / (100 * F.col("open")).cast("double")
    return per.select("source", "source_size", "place", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest).alias("target"))


def _position(u: Column, place: Column) -> Column:
    """Training time at which the share ``u`` of a source's demand is reached."""
    out = F.lit(None).cast("double")
    for s, rates in enumerate(SCHEDULES):
        parts = [(b - a) * (v + w) / 2 for a, b, v, w in zip(KNOTS, KNOTS[1:], rates, rates[1:], strict=False)]
        whole, start, time = sum(parts), 0.0, None
        for a, b, v, w, part in zip(KNOTS, KNOTS[1:], rates, rates[1:], parts, strict=False):
            # the demand within the piece: v x + (w - v) x^2 / (2 (b - a)); the root is written so that equal rates need no case of their own
            need = F.greatest(u * whole - start, F.lit(0.0))
            x = 2 * need / (v + F.sqrt(F.greatest(F.lit(v * v) + 2 * (w - v) / (b - a) * need, F.lit(0.0))))
            here = u * whole < start + part
            time = F.when(here, a + x) if time is None else time.when(here, a + x)
            start += part
        out = F.when(place % len(SCHEDULES) == s, time.otherwise(F.lit(KNOTS[-1]))).otherwise(out)
    return out


def mix(docs: DataFrame, percent: int = 150, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """The rows of ``placed``, range-sorted by the position of their first take; rows that the mix leaves out come last.

    They are written before they are sorted, as the ranges come from a sample.
    """
    rows = materialize(placed(docs, percent, weights, most), "mix-placed")
    order = [F.asc_nulls_last(F.get("takes", F.lit(0))["position"]), F.asc_nulls_first("doc_id"), F.asc("size"), F.asc_nulls_first("text_hash")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def placed(docs: DataFrame, percent: int = 150, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken, takes) of every row, in no order.

    takes: array of (pass, words, position), one for each pass that takes words of the document.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = materialize(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"), hashed.alias("h")), "mix-sizes")
    digits = max(1, math.ceil(math.log(max(1, rows.count() / RANGE_ROWS), 16))) + 1
    goal = materialize(targets(rows.select("source", "size"), percent, weights, most), "mix-targets")
    rows = rows.withColumn("range", F.substring("h", 1, digits))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    ranges = ranges.withColumn("before", F.sum("sum").over(Window.partitionBy("source").orderBy("range")) - F.col("sum"))
    ranges = ranges.join(goal.hint("broadcast") if goal.count() <= 10_000 else goal, same(ranges["source"], goal["source"])).select(
        ranges["source"].alias("s"), ranges["range"].alias("r"), "before", "source_size", "target", "place"
    )
    inner = Window.partitionBy("source", "range").orderBy("h", F.asc_nulls_first("doc_id"), "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("within", F.sum("size").over(inner) - F.col("size"))
    found = found.join(ranges, same(F.col("source"), F.col("s")) & (F.col("range") == F.col("r")))
    start = F.col("before") + F.col("within")
    budget = F.floor("target").cast("long")

    def take(k: int) -> Column:
        left = budget - k * F.col("source_size") - start
        n = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
        middle = (k * F.col("source_size") + start + n / 2) / F.greatest(F.col("target"), F.lit(1.0))
        return F.struct(F.lit(k).alias("pass"), n.alias("words"), _position(middle, F.col("place")).alias("position"))

    takes = F.filter(F.array(*(take(k) for k in range(most))), lambda x: x["words"] > 0)
    out = found.select("doc_id", "text_hash", "source", "size", "source_size", "target", takes.alias("takes"))
    return out.withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]))


def mixed_documents(docs: DataFrame, percent: int = 150) -> DataFrame:
    """The mix itself: ``docs``, each row as often as it is taken, range-sorted by ``es_position``; a cut row's text is its first words.

    Rows with the same id, text and source all get the takes of the first of them.
    """
    made = placed(docs.select("doc_id", "source", "text"), percent).filter("taken > 0")
    made = made.select(F.col("doc_id").alias("es_id"), F.col("text_hash").alias("es_hash"), F.col("source").alias("es_source"), F.col("size").alias("es_size"), "takes")
    made = made.groupBy("es_id", "es_hash", "es_source", "es_size").agg(F.min("takes").alias("takes"))
    rows = docs.select(as_row([c for c in docs.columns if c != "text"]), "text", "doc_id", "source", F.xxhash64("text").alias("hash"))
    joined = rows.join(made, same(F.col("doc_id"), F.col("es_id")) & (F.col("hash") == F.col("es_hash")) & same(F.col("source"), F.col("es_source")))
    each = joined.withColumn("take", F.explode("takes"))
    text = F.when(F.col("take.words") < F.col("es_size"), F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("take.words").cast("int")), " ")).otherwise(F.col("text"))
    names = [c for c in docs.columns if c != "es_position"]
    each = each.select("row", text.alias("text"), F.col("take.position").alias("es_position"), "doc_id")
    out = each.repartitionByRange(F.col("es_position"), F.col("doc_id")).sortWithinPartitions("es_position", "doc_id")
    return out.select(*of_row(names), "es_position")
