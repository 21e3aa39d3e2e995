"""SimHash near-duplicates by a self-join of a binary trie.

Equal fingerprints are one class from the start, so copies never meet as pairs.
The trie holds the distinct fingerprints. Its self-join walks pairs of nodes of
equal depth together, adds up the bits in which their paths differ, and leaves a
pair as soon as the sum is over the error budget; nodes of few fingerprints are
compared directly.

The trie is dealt to tasks by the pigeonhole rule: of ``budget + a`` blocks of
the 64 bits, two linked fingerprints agree in ``a`` at least. For each choice of ``a``
blocks the fingerprints' bits are reordered to start with them; a task walks the
sub-tries below some values of these. With more fingerprints ``a`` is 1, 2 or 4, so that
a value has few; each is copied at most 70 times (``budget`` 4), however many there are. A value
with too many fingerprints all the same is split into groups, and each pair of groups is a
task of its own, so what a task holds is bounded and no pair is lost. A task reports a spanning forest of the links that it finds,
never all pairs. Components are found over these edges.

A text is lower-cased (A-Z), its words are joined to shingles, every shingle's
XXH64 votes on each bit. Defined results: null and empty texts have no words and
fingerprint zero, and are linked like others. A null id names no component; a
component with null ids only has a null id. Repeated rows or ids are returned
each time. Other columns are ignored. A text of any length is handled whole, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import as_row, chunks, of_row, text_bytes
from echosieve.operators.components import connected_components
from echosieve.storage import Scratch, materialize

_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, size: int, seed: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        starts = [0, *ends[: len(words) - size]]
        parts = [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :], strict=True)]
        hashes = list(map(xxhash.xxh64_intdigest, parts, repeat(seed)))
    return fold(np.array(hashes, "<u8"))


def fold(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    h = h.astype("<u8", copy=False)
    votes = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(size: int, seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = np.array([fingerprint(x, size, seed) for x in text_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps.view(np.int64))], [*names, "fp"])

    return run


class Deal:
    """How fingerprints are dealt: of ``blocks`` blocks of their bits, links agree in at least ``blocks - budget``; each choice of so many is a key."""

    def __init__(self, blocks: int, budget: int):
        starts = [round(64 * i / blocks) for i in range(blocks + 1)]
        #: first bit, from the most significant, and width of each block
        self.blocks = [(a, b - a) for a, b in zip(starts, starts[1:], strict=False)]
        self.keys = list(combinations(range(blocks), blocks - budget))
        self.widths = [sum(self.blocks[b][1] for b in key) for key in self.keys]

    def value(self, key: tuple[int, ...]) -> Column:
        """The bits of the key's blocks."""
        out = F.lit(0).cast("long")
        for b in key:
            start, width = self.blocks[b]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", 64 - start - width).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return out

    def first(self, x: np.ndarray, key: tuple[int, ...]) -> np.ndarray:
        """The fingerprints with the key's blocks moved to the front."""
        out = np.zeros(len(x), np.uint64)
        for b in [*key, *(b for b in range(len(self.blocks)) if b not in key)]:
            start, width = self.blocks[b]
            out = (out << np.uint64(width)) | (x >> np.uint64(64 - start - width)) & np.uint64((1 << width) - 1)
        return out


def deal_for(n: int, budget: int, group: int) -> Deal:
    """The fewest keys for which ``n`` fingerprints are few to a value: with a budget of 4, 5 of 12 bits, 15 of 20 or 70 of 32."""
    deals = [Deal(budget + more, budget) for more in (1, 2, 4)]
    return next((d for d in deals if n >> min(d.widths) <= group // 4), deals[-1])


class Forest:
    """Links found so far among n items, as a label of each item's tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def trie_links(x: np.ndarray, depth: int, budget: int, at_once: int = 1 << 18, small: int = 64) -> Forest:
    """Links of the sorted distinct 64-bit ``x`` that agree in the first ``depth`` bits and differ in at most ``budget``."""
    forest = Forest(len(x))
    top = x >> np.uint64(64 - depth) if depth else np.zeros(len(x), np.uint64)
    cut = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if len(x) else np.zeros(0, np.int64)
    lo, hi = cut, np.append(cut[1:], len(x)) if len(x) else cut
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        d, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > at_once:
            half = len(lo1) // 2
            stack += [(d, *(v[half:] for v in (lo1, hi1, lo2, hi2, err))), (d, *(v[:half] for v in (lo1, hi1, lo2, hi2, err)))]
            continue
        n1, n2 = hi1 - lo1, hi2 - lo2
        own = lo1 == lo2
        live = (n1 > 0) & (n2 > 0) & (err <= budget) & ~(own & (n1 == 1))
        leaf = live & ((n1 * n2 <= small) | (d == 64))
        if leaf.any():
            a, b, m1, m2 = lo1[leaf], lo2[leaf], n1[leaf], n2[leaf]
            sizes = m1 * m2
            pair = np.repeat(np.arange(len(sizes)), sizes)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i, j = a[pair] + k // m2[pair], b[pair] + k % m2[pair]
            near = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            forest.link(i[near], j[near])
        inner = live & ~leaf
        if not inner.any():
            continue
        lo1, hi1, lo2, hi2, err, own = (v[inner] for v in (lo1, hi1, lo2, hi2, err, own))
        bit = _ONE << np.uint64(63 - d)
        low = (bit << _ONE) - _ONE if d else _ALL
        mid1 = np.searchsorted(x, (x[lo1] & ~low) | bit)
        mid2 = np.where(own, mid1, np.searchsorted(x, (x[lo2] & ~low) | bit))
        turn = ~own
        parts = [
            (lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, err + 1),
            (mid1[turn], hi1[turn], lo2[turn], mid2[turn], err[turn] + 1),
        ]
        stack.append((d + 1, *(np.concatenate(v) for v in zip(*parts, strict=True))))
    return forest


def _links(deal: Deal, budget: int, at_once: int):
    """Links within the values of each key. Rows of a value follow each other; about ``at_once`` rows of whole values are held."""

    def linked(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        block, part, fp = cols[0], cols[1], cols[3].view(np.uint64)
        order = np.lexsort((part, block))
        block, part, fp = block[order], part[order], fp[order]
        cut = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (part[1:] != part[:-1]), [True])))
        for a, b in zip(cut, cut[1:], strict=False):
            k = int(block[a])
            x, at = np.unique(deal.first(fp[a:b], deal.keys[k]), return_index=True)
            label = trie_links(x, deal.widths[k], budget).label
            found = np.flatnonzero(label != np.arange(len(x)))
            own = fp[a:b][at].view(np.int64)
            yield pa.RecordBatch.from_pydict({"u": pa.array(own[found]), "v": pa.array(own[label[found]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("block", "part", "deal", "fp")]
            if not len(cols[0]):
                continue
            if held and sum(len(c[0]) for c in held) >= at_once:
                # up to the first value that starts in this batch
                new = np.flatnonzero((cols[2] != held[-1][2][-1]) | (cols[0] != held[-1][0][-1]))
                if len(new):
                    yield from linked([np.concatenate(v) for v in zip(*held, [c[: new[0]] for c in cols], strict=True)])
                    held, cols = [], [c[new[0] :] for c in cols]
            held.append(cols)
        if held:
            yield from linked([np.concatenate(v) for v in zip(*held, strict=True)])

    return run


def fingerprint_links(fps: DataFrame, budget: int = 4, group: int = 4096, broadcast_rows: int = 100_000, deal: Deal | None = None, at_once: int = 1 << 20) -> DataFrame:
    """(u, v): edges that connect exactly the fingerprints (distinct ``fp``, cheap to read again) that chains of links connect."""
    deal = deal or deal_for(fps.count(), budget, group)
    rows = fps.select("fp", F.inline(F.array(*(F.struct(F.lit(k).alias("block"), deal.value(key).alias("value")) for k, key in enumerate(deal.keys)))))
    hot = materialize(rows.groupBy("block", "value").count().filter(F.col("count") > group), "hot-blocks")
    n = hot.count()
    if n:
        rows = rows.join(F.broadcast(hot) if n <= broadcast_rows else hot, ["block", "value"], "left").withColumn("groups", F.coalesce(F.ceil(F.col("count") / group), F.lit(1)).cast("int"))
        own = F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int")
        rows = rows.select("fp", "block", "value", "groups", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"))
        task = F.struct("value", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select("fp", "block", F.when(F.col("groups") > 1, F.xxhash64("block", task)).otherwise(F.lit(0)).alias("part"), F.xxhash64("block", task).alias("deal"))
    else:
        rows = rows.select("fp", "block", F.lit(0).cast("long").alias("part"), F.xxhash64("block", "value").alias("deal"))
    dealt = rows.select("block", "part", "deal", "fp").repartition("deal").sortWithinPartitions("block", "deal")
    return dealt.mapInArrow(_links(deal, budget, at_once), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, size: int = 4, seed: int = 42, budget: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(id, text_hash, fp, component_id) of every row; component_id is the smallest id that links reach."""
    with Scratch() as own:
        found, scanned = _search(docs, size, seed, budget, id_col)
        own.release(*scanned)
    return found


def _search(docs: DataFrame, size: int, seed: int, budget: int, id_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """What near_duplicates returns, and the tables that it scans."""
    kept = docs.select(F.col(id_col), "text", F.xxhash64("text").alias("text_hash"))
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, text_hash long, fp long"
    marks = materialize(kept.mapInArrow(_fingerprints(size, seed, [id_col, "text_hash"]), schema), "fingerprints")
    classes = materialize(marks.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprint-classes")
    labels = connected_components(fingerprint_links(classes.select("fp"), budget))
    rooted = classes.join(labels, classes["fp"] == labels["vertex"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select(id_col, "text_hash", "fp", "component_id"), [marks, rooted]


def one_of_each(docs: DataFrame, size: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the smallest (id, text hash); null ids come last."""
    return first_of_each(docs, near_duplicates(docs.select("doc_id", "text"), size, seed, budget))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the smallest (id, text hash) of each component of ``found``: (doc_id, text_hash, fp, component_id)."""
    absent = F.lit(2**63 - 1)
    # components whose ids are all null are told apart by their fingerprints
    pick = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(F.min(F.struct(F.coalesce("doc_id", absent).alias("i"), F.col("text_hash").alias("h"))).alias("x"))
    pick = pick.select(F.col("x.i").alias("es_id"), F.col("x.h").alias("es_hash")).distinct()
    keyed = docs.select(as_row([c for c in docs.columns if c != "text"]), "text", F.coalesce("doc_id", absent).alias("es_id"), F.xxhash64("text").alias("es_hash"))
    return keyed.join(pick, ["es_id", "es_hash"], "left_semi").dropDuplicates(["es_id", "es_hash"]).select(*of_row(docs.columns))
