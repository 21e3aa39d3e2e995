"""Near-duplicates by the Jaccard similarity of word shingles, exact and complete.

Two texts are linked if their sets of shingles (five words, lower-cased A-Z) have
a similarity of 0.8 or more; components of links are groups. Texts of equal sets
are one class from the start.

Most links come from the trie self-join of SimHash fingerprints (64 bits of the
set, ``budget`` differing ones), each counted on the shingles. At a similarity of
0.8 fingerprints differ in about 10 bits of 64, far more than a trie can prune by,
so the self-join alone would lose most links between 0.8 and 0.95; the rest comes
from a second search, which is complete.

Its candidates come from prefixes: under any one order of all shingles, two sets of
similarity t share one of the first n - ceil(t n) + 1 of each. The order puts the
shingles that a sample of the texts shows to be common last, so what is common
to many texts hardly ever makes a candidate; the sample only sets the order.
Each class is first compared with one class, of another component, of each of its shingles. Shingles
whose classes are then in one component are done; for the others, all pairs
across components are compared. A pair is left early where the places of its
shared shingle or the bits in which two small maps of the sets differ prove that
it is below the threshold; what is left is counted on the shingles themselves.

Defined results: null and empty texts have no shingles and are one class; a text
of fewer than five words has one shingle, all its words. Shingles are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import chunks, text_bytes, word_hashes
from echosieve.llm.simhash import fingerprint_links, first_of_each, fold
from echosieve.operators.components import connected_components
from echosieve.storage import Scratch, discard, materialize

_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
#: Bits of the map of a set, at least.
MAP_BITS = 2048
#: Bytes of text taken at once.
_CHUNK = 2 << 20
#: One different text in so many is counted to find common shingles, which so many of the sample share; at most so many are told apart.
SAMPLE, COMMON, MOST_COMMON = 16, 4, 1 << 20
_EPS = 1e-9


class Sets:
    """The ascending distinct shingle hashes of several texts, one after the other: those of text i are ``h[ends[i] - n[i] : ends[i]]``."""

    def __init__(self, texts: list[bytes], size: int):
        parts = [t.lower().split() for t in texts]
        words = np.array([len(p) for p in parts], np.int64)
        w = word_hashes(parts, int(words.sum()))
        # a text of fewer words than a shingle has one, of all its words
        span = np.minimum(words, size)
        many = np.where(words > 0, words - span + 1, 0)
        text = np.repeat(np.arange(len(words)), many)
        at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + (np.cumsum(words) - words)[text]
        own = span[text]
        h = own.astype(np.uint64)
        for k in range(size):
            used = own > k
            step = (h ^ w[np.where(used, at + k, 0)]) * _MIX
            h = np.where(used, step ^ (step >> _TURN), h)
        ends = np.cumsum(many)
        for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True):
            h[a:b].sort()
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.zeros(0, bool)
        self.h, self.text = h[new], text[new]
        self.n = np.bincount(self.text, minlength=len(words))
        self.ends = np.cumsum(self.n)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.h[self.ends[i] - self.n[i] : self.ends[i]]

    def keys(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(self[i].tobytes()) - 2**63 for i in range(len(self.n))], np.int64)

    def maps(self) -> list[bytes]:
        """Of each text the places that its shingles take among MAP_BITS, or the power of two of at least 4 for each shingle."""
        out = []
        for i, n in enumerate(self.n.tolist()):
            size = max(MAP_BITS, 1 << (4 * n - 1).bit_length() if n else 0)
            bits = np.zeros(size, np.uint8)
            bits[(self[i] & np.uint64(size - 1)).astype(np.int64)] = 1
            out.append(np.packbits(bits).tobytes())
        return out


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - _EPS) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two ascending sets reach the threshold."""
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common >= threshold * (len(a) + len(b) - common) - _EPS


def _marks(size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=_CHUNK):
            sets = Sets(text_bytes(batch.column("text")), size)
            prints = np.array([fold(sets[i]) for i in range(len(sets.n))], np.uint64).view(np.int64)
            own = [pa.array(sets.keys()), pa.array(sets.n), pa.array(sets.maps(), pa.binary()), pa.array(prints)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], [*names, "key", "n", "map", "fp"])

    return run


def _all_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=_CHUNK):
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(Sets(text_bytes(batch.column("text")), size).h.view(np.int64))})

    return run


def _prefixes(size: int, threshold: float, common):
    """(shingle, key, place): the prefix of each text; ``place`` is 2**31 times the size of the set plus the place in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = common.value
        for batch in chunks(batches, limit=_CHUNK):
            sets = Sets(text_bytes(batch.column("text")), size)
            h, text = sets.h, sets.text
            if len(known) and len(h):
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                h = h[np.lexsort((np.where(known[at] == h, counts[at], 0), text))]
            place = np.arange(len(h)) - (sets.ends - sets.n)[text]
            kept = place < np.array([prefix_length(n, threshold) for n in sets.n.tolist()], np.int64)[text]
            h, text, place = h[kept], text[kept], place[kept]
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(h.view(np.int64)), "key": pa.array(sets.keys()[text]), "place": pa.array((sets.n[text] << 31) + place)})

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows of shingles with two classes or more; all rows of a shingle are in one partition."""
    held = [[b.column(c).to_numpy() for c in ("shingle", "key", "place")] for b in batches if b.num_rows]
    if not held:
        return
    shingle, key, place = (np.concatenate(v) for v in zip(*held, strict=True))
    order = np.lexsort((key, shingle))
    shingle, key, place = shingle[order], key[order], place[order]
    fresh = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])))
    shingle, key, place = shingle[fresh], key[fresh], place[fresh]
    same = shingle[1:] == shingle[:-1]
    kept = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    rows = pa.RecordBatch.from_pydict({"shingle": pa.array(shingle[kept]), "key": pa.array(key[kept]), "place": pa.array(place[kept])})
    for a in range(0, rows.num_rows, 1 << 16):
        yield rows.slice(a, 1 << 16)


def _maps_allow(threshold: float):
    @F.pandas_udf("boolean")
    def run(map_a: pd.Series, map_b: pd.Series, n: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype="bool")
        differ = np.zeros(len(n), np.int64)
        small = ((map_a.str.len() == MAP_BITS // 8) & (map_b.str.len() == MAP_BITS // 8)).to_numpy()
        if small.any():
            a, b = (np.frombuffer(b"".join(x[small]), np.uint64).reshape(int(small.sum()), -1) for x in (map_a, map_b))
            differ[small] = np.bitwise_count(a ^ b).sum(1)
        for i in np.flatnonzero(~small):
            a, b = sorted((np.frombuffer(x.iloc[i], np.uint64) for x in (map_a, map_b)), key=len)
            # the larger map folded to the size of the smaller
            differ[i] = np.bitwise_count(a ^ np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)).sum()
        return pd.Series(differ <= n.to_numpy() * (1 - threshold) / (1 + threshold) + _EPS)

    return run


def _similar(size: int, threshold: float, at_once: int = 256):
    """(u, v): the pairs that reach the threshold, few and of few bytes at once, since each brings both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a", 1 << 20):
            for x in range(0, batch.num_rows, at_once):
                part = batch.slice(x, at_once)
                sets = [Sets(text_bytes(part.column(c)), size) for c in ("text_a", "text_b")]
                kept = pa.array([similar(sets[0][i], sets[1][i], threshold) for i in range(part.num_rows)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(kept), part.column("b").filter(kept)], ["u", "v"])

    return run


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, threshold: float, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold."""
    side = lambda s: classes.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("map").alias(f"map_{s}"))
    rows = pairs.join(side("a"), "a").filter("n_a > 0").join(side("b"), "b").filter("n_b > 0")
    rows = rows.filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - _EPS)
    near = materialize(rows.filter(_maps_allow(threshold)("map_a", "map_b", F.col("n_a") + F.col("n_b"))).select("a", "b"), "near-pairs")
    keys = near.select(F.col("a").alias("key")).union(near.select(F.col("b").alias("key"))).distinct()
    wanted = materialize(classes.join(keys, "key", "left_semi").select("key", "text_hash"), "near-classes")
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash").groupBy("key").agg(F.min("text").alias("text"))
    texts = materialize(texts, "near-texts")
    text = lambda s: texts.select(F.col("key").alias(s), F.col("text").alias(f"text_{s}"))
    rows = near.join(text("a"), "a").join(text("b"), "b")
    links = materialize(rows.select("a", "b", "text_a", "text_b").mapInArrow(_similar(size, threshold), "u long, v long"), "near-links")
    discard(near, texts)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, budget: int = 4, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row; ``fp`` is its class, component_id the smallest id that links reach."""
    with Scratch() as own:
        found, kept = _search(docs, size, threshold, budget, broadcast_rows)
        own.release(*kept)
    return found


def _search(docs: DataFrame, size: int, threshold: float, budget: int, broadcast_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """What near_duplicates returns, and the tables that it scans."""
    spark = docs.sparkSession
    kept = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text_hash long, key long, n long, map binary, fp long"
    marks = materialize(kept.mapInArrow(_marks(size, ["doc_id", "text_hash"]), schema), "shingle-marks")
    classes = materialize(marks.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.min("n").alias("n"), F.min("map").alias("map"), F.min("fp").alias("fp")), "shingle-classes")
    check = lambda pairs: _verified(pairs, classes, docs, size, threshold, broadcast_rows)

    prints = materialize(classes.filter("n > 0").groupBy("fp").agg(F.min("key").alias("first")), "set-fingerprints")
    one = lambda s: prints.select(F.col("fp").alias(s), F.col("first").alias({"u": "a", "v": "b"}[s]))
    near = fingerprint_links(prints.select("fp"), budget).join(one("u"), "u").join(one("v"), "v").select("a", "b")
    equal = classes.join(prints, "fp").filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    links = check(near.unionByName(equal).distinct())
    labels = connected_components(links)

    texts = docs.select("text")
    sampled = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counted = sampled.mapInArrow(_all_shingles(size), "shingle long").groupBy("shingle").count().filter(F.col("count") >= COMMON)
    counted = counted.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    h = counted.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(h)
    common = spark.sparkContext.broadcast((h[order], counted.column("count").to_numpy()[order]))

    ddl = "shingle long, key long, place long"
    shared = texts.mapInArrow(_prefixes(size, threshold, common), ddl).repartition("shingle").mapInArrow(_shared, ddl)
    shared = materialize(shared, "shared-shingles")

    def labelled(labels: DataFrame) -> DataFrame:
        rows = shared.join(labels, F.col("key") == F.col("vertex"), "left")
        return materialize(rows.select("shingle", "key", "place", F.coalesce("component", "key").alias("component")), "labelled-shingles")

    rows = labelled(labels)
    first = rows.groupBy("shingle").agg(F.min(F.struct("component", "key")).alias("x")).select("shingle", F.col("x.component").alias("c"), F.col("x.key").alias("a"))
    links = links.unionByName(check(rows.join(first, "shingle").filter("component <> c").select("a", F.col("key").alias("b")).distinct()))
    labels = connected_components(links)

    discard(rows)
    rows = labelled(labels)
    several = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("many")).filter("low <> high and many > 2")
    rows = rows.join(several.select("shingle"), "shingle", "left_semi").select("shingle", "key", "component", F.shiftright("place", 31).alias("n"), F.col("place").bitwiseAND((1 << 31) - 1).alias("i"))
    other = rows.select(*(F.col(c).alias(c if c == "shingle" else f"{c}_2") for c in rows.columns))
    reach = F.least(F.col("n") - F.col("i"), F.col("n_2") - F.col("i_2"))
    near = rows.join(other, "shingle").filter((F.col("key") < F.col("key_2")) & (F.col("component") != F.col("component_2")))
    near = near.filter(reach >= threshold / (1 + threshold) * (F.col("n") + F.col("n_2")) - _EPS)
    links = links.unionByName(check(near.select(F.col("key").alias("a"), F.col("key_2").alias("b")).distinct()))
    labels = connected_components(links)

    rooted = classes.join(labels, F.col("key") == F.col("vertex"), "left").select("key", "least", F.coalesce("component", "key").alias("root"))
    rooted = materialize(rooted, "shingle-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = marks.join(rooted.join(least, "root").select("key", "component_id"), "key").select("doc_id", "text_hash", F.col("key").alias("fp"), "component_id")
    return found, [marks, rooted]


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: the smallest (id, text hash); null ids come last."""
    return first_of_each(docs, near_duplicates(docs.select("doc_id", "text"), size, threshold))
