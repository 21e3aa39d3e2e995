"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Four ratios of each document that passes the fixed base rule go into quantile
sketches, one for each language and source: counts by logarithmic bucket (32 to
an octave, exact below 64), which merge by addition, give the same result in any
order and bound a quantile's error to 1/32. A group with too few documents uses
its language's merged sketch, or that of all documents. A ratio fails beyond
q75 + fence * max(q75 - q25, slack), for the word length also below
q25 - fence * max(q75 - q25, slack). The limits are joined to the documents by
language and source.

Built from DataFrame operations only. The texts are read once; sketches and
verdicts come from a narrow table of counts. The limits are broadcast only when
their number has been counted and is small; otherwise they are joined.

Defined results: a null or empty text has no words and fails the base rule. Null
languages or sources form groups of their own. Rows are independent, so repeated
rows and null or repeated ids get a verdict each. An empty table gives an empty
result. Other columns pass through, whatever their names; the columns added
replace those of the same names. Texts of any length are one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echosieve.llm.common import as_row, of_row, same, words
from echosieve.storage import materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Ratio -> (numerator, factor, denominator, slack, whether low values fail, too).
RATIOS = {
    "repeats": ("n_repeat_words", 1000, "n_words", 40, False),
    "symbols": ("n_symbols", 1000, "word_chars", 10, False),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 60, False),
    "length": ("word_chars", 100, "n_words", 40, True),
}
BROADCAST_ROWS = 100_000


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with the columns of COUNTS under the prefix ``es_``."""
    text = F.coalesce("text", F.lit(""))
    others = [F.col(c) for c in docs.columns if c != "text"]
    # inline() makes a column of what it is given, once; else the optimiser may move a split into the lambdas that use it
    made = docs.select(*others, F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("es_n_symbols"), F.inline(F.array(F.struct(words(F.col("text")).alias("es_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("es_l")))))
    n = F.size("es_w")
    at = lambda i: F.get(F.col("es_w"), i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    made = made.select(
        *others, "es_n_symbols", n.cast("long").alias("es_n_words"), F.length(F.array_join("es_w", "")).cast("long").alias("es_word_chars"),
        F.size("es_l").cast("long").alias("es_n_lines"), (F.size("es_l") - F.size(F.array_distinct("es_l"))).cast("long").alias("es_n_dup_lines"), F.inline(F.array(F.struct(windows.alias("es_h")))),
    )
    carried = [*others, *(f"es_{c}" for c in COUNTS if c != "n_repeat_words")]
    repeated = F.size(F.array_distinct("es_h")) < F.size("es_h")
    ordered = F.when(repeated, F.array_sort(F.transform("es_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    made = made.select(*carried, F.inline(F.array(F.struct(ordered.alias("es_s")))))
    hash_at = lambda j: F.get(F.col("es_s"), j)["h"]
    twice = F.filter("es_s", lambda x, j: F.coalesce(x["h"] == hash_at(j - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(j + 1), F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return made.select(*carried, covered.cast("long").alias("es_n_repeat_words"))


def bucket(v: Column) -> Column:
    """Sketch bucket of a whole number from 0: itself below 64, then 32 to an octave."""
    e = F.length(F.bin(v)) - 1
    return F.when(v < 64, v).otherwise(64 + (e - 6) * 32 + (F.floor(v / F.pow(F.lit(2.0), e - 5)).cast("long") - 32)).cast("long")


def bucket_low(b: Column) -> Column:
    """Least number in a bucket."""
    return F.when(b < 64, b).otherwise((32 + (b - 64) % 32) * F.pow(F.lit(2.0), F.floor((b - 64) / 32) + 1).cast("long")).cast("long")


def _ratio(name: str) -> Column:
    top, factor, under, _, _ = RATIOS[name]
    return F.floor(F.col(f"es_{top}") * factor / F.greatest(F.col(f"es_{under}"), F.lit(1))).cast("long")


def base_failed() -> Column:
    return (F.col("es_n_words") < 50) | (100 * F.col("es_n_repeat_words") > 50 * F.col("es_n_words"))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, b, n): the sketches of all groups."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("ratio"), bucket(_ratio(name)).alias("b")) for name in RATIOS)))
    rows = counted.filter(~base_failed()).select("lang", "source", each.alias("x"))
    return rows.groupBy("lang", "source", F.col("x.ratio").alias("ratio"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))


def limits(sketch: DataFrame, fence: int = 8, min_docs: int = 100) -> DataFrame:
    """(lang, source, low_<ratio>, high_<ratio>) of every group in the sketches."""

    def fences(keys: list[str], mark: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "ratio", "b").agg(F.sum("n").alias("n"))
        own = Window.partitionBy(*keys, "ratio")
        ranked = merged.withColumn("below", F.sum("n").over(own.orderBy("b"))).withColumn("all", F.sum("n").over(own))
        q = lambda k: F.min(F.when(F.col("below") * 4 >= F.col("all") * k, F.col("b")))
        found = ranked.groupBy(*keys, "ratio").agg(bucket_low(q(1)).alias("q25"), bucket_low(q(3)).alias("q75"), F.max("all").alias("docs"))
        slack = reduce(lambda e, name: e.when(F.col("ratio") == name, RATIOS[name][3]), RATIOS, F.when(F.lit(False), 0))
        wide = fence * F.greatest(F.col("q75") - F.col("q25"), slack)
        found = found.select(*keys, "ratio", "docs", (F.col("q75") + wide).alias("high"), (F.col("q25") - wide).alias("low"))
        value = lambda name, side: F.max(F.when(F.col("ratio") == name, F.col(side))).alias(f"{mark}_{side}_{name}")
        return found.groupBy(*keys).agg(F.max("docs").alias(f"{mark}_docs"), *(value(name, side) for name in RATIOS for side in ("low", "high")))

    own = fences(["lang", "source"], "own")
    lang = fences(["lang"], "lang").withColumnRenamed("lang", "lang_key")
    joined = own.join(lang, same(F.col("lang"), F.col("lang_key")), "left").crossJoin(F.broadcast(fences([], "any")))
    pick = lambda side, name: F.when(F.col("own_docs") >= min_docs, F.col(f"own_{side}_{name}")).when(F.col("lang_docs") >= min_docs, F.col(f"lang_{side}_{name}")).otherwise(F.col(f"any_{side}_{name}"))
    return joined.select("lang", "source", *(pick(side, name).alias(f"{side}_{name}") for name in RATIOS for side in ("low", "high")))


def judge(docs: DataFrame, fence: int = 8, min_docs: int = 100, keep_text: bool = False) -> DataFrame:
    """``docs`` (text, lang, source) with the counts, ``es_base_failed`` and ``es_kept``; ``text`` itself only with ``keep_text``."""
    made = [*(f"es_{c}" for c in COUNTS), "es_base_failed", "es_kept"]
    others = [c for c in docs.columns if c not in ("text", *made)]
    text = [F.col("text").alias("whole")] if keep_text else []
    counted = materialize(text_counts(docs.select(as_row(others), "lang", "source", "text", *text)), "counts")
    bounds = materialize(limits(sketches(counted), fence, min_docs).select(F.col("lang").alias("es_lang"), F.col("source").alias("es_source"), *(F.col(f"{side}_{name}").alias(f"es_{side}_{name}") for name in RATIOS for side in ("low", "high"))), "limits")
    if bounds.count() <= BROADCAST_ROWS:
        bounds = F.broadcast(bounds)
    joined = counted.join(bounds, same(F.col("lang"), F.col("es_lang")) & same(F.col("source"), F.col("es_source")), "left")
    fine = F.lit(True)
    for name, (_, _, _, _, low) in RATIOS.items():
        fine = fine & (_ratio(name) <= F.col(f"es_high_{name}"))
        if low:
            fine = fine & (_ratio(name) >= F.col(f"es_low_{name}"))
    text = [F.col("whole").alias("text")] if keep_text else []
    return joined.select(*of_row(others), *text, *(f"es_{c}" for c in COUNTS), base_failed().alias("es_base_failed"), (~base_failed() & F.coalesce(fine, F.lit(True))).alias("es_kept"))
