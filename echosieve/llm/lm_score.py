"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised to 1 + floor(log2(count)). The
filter holds each n-gram once for every level up to its own; the level of an
n-gram is read back by probing level after level until one is missing. Errors
are one-sided: a false positive can only raise a level.

p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), and
p(w | u) = m(u) min(1, c(u, w) / c(u)) + (1 - m(u)) p(w), every c being the mean
count of the level read from the filter. m(u) depends on the level of u alone:
tokens / (tokens + distinct pairs) over all contexts of that level
(Witten-Bell by count class). The context of a text's first token is the end token.

Sizes: the filter has ``bits_per_token`` bits for every training token at every
size, so false positives don't grow with the input. It is broadcast in passes of
``max_bits`` (32 MB) of segments. The texts are read once: each chunk of texts
writes, for every pass, the n-grams that it will ask for there, with the levels of
their words; a pass reads its own probes alone, so the work of all passes together
is in proportion to the tokens, whatever the number of passes. The word filter, far
smaller, is broadcast whole up to ``max_word_bits`` (64 MB, 22 million words);
beyond that, passes over the texts write the level of each token beside them first.
Segments of the filter are built by the tasks that own their n-grams. Exact unigram
counts, which only the base score uses, reach the texts two ways: words with at
least N / 2**20 occurrences (at most 2**20 words) are broadcast, rarer ones are joined.

Defined results: null is the empty text, which has one token, its end. With no
training rows N and V are 0 and p(w) = 1. Repeated rows count and are returned
each time. Ids may be null or repeat. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import chunks, text_bytes, word_hashes
from echosieve.storage import Scratch, discard, materialize

_MIX, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The end token; no word hashes are fixed, so this value only has to differ from them by chance.
END = np.uint64(0x5851F42D4C957F2D)
HEAVY_SHARE = 1 << 20
#: Bytes of text taken at once; fewer where much is held for each token.
_CHUNK, _ASKED = 4 << 20, 1 << 20


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ended by END, and the number of tokens of each."""
    parts = [x.lower().split() for x in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    out = np.full(int(sizes.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    if inner.any():
        out[inner] = word_hashes(parts, len(out) - len(parts))
    return out, sizes


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _PAIR
    return h ^ (h >> np.uint64(32))


def pairs(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token's pair with the one before it, and that context's hash."""
    before = np.concatenate(([END], h[:-1])) if len(h) else h
    starts = np.cumsum(sizes) - sizes
    before[starts] = END
    return mixed(before * _PAIR + mixed(h)), before


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """Mean of the counts of a level; 0 for level 0."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


class Filter:
    """Levelled Bloom filter of ``segments`` equal parts; an n-gram lives in one part, and all bits of one of its levels in one 64-bit word, so a probe reads memory once."""

    def __init__(self, segments: int, segment_words: int, parts: dict[int, np.ndarray] | None = None, held: range | None = None):
        self.segments, self.segment_words = segments, segment_words
        self.parts = parts or {}
        self.held = range(segments) if held is None else held
        self.flat: np.ndarray | None = None

    @staticmethod
    def place(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Segment of an n-gram's hash, and the 40 bits that name it there, both from its lower 48 bits. Equal names only merge counts, upwards."""
        return ((h >> np.uint64(24) & np.uint64((1 << 24) - 1)) % np.uint64(segments)).astype(np.int64), h & np.uint64((1 << 40) - 1)

    def _probe(self, key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Word within the part, and the four bits there."""
        a = mixed(key + np.uint64(level * int(_MIX) % 2**64))
        one, low = np.uint64(1), np.uint64(63)
        bits = one << (a & low) | one << (a >> np.uint64(6) & low) | one << (a >> np.uint64(12) & low) | one << (a >> np.uint64(18) & low)
        return ((a >> np.uint64(24)) % np.uint64(self.segment_words)).astype(np.int64), bits

    def put(self, segment: int, key: np.ndarray, level: np.ndarray) -> None:
        part = self.parts.setdefault(segment, np.zeros(self.segment_words, np.uint64))
        for j in range(1, int(level.max()) + 1):
            np.bitwise_or.at(part, *self._probe(key[level >= j], j))

    def join(self) -> "Filter":
        """The held parts in one array, ready for probes."""
        if self.flat is None:
            self.flat = np.zeros(len(self.held) * self.segment_words, np.uint64)
            for s in sorted(self.parts):
                at = s - self.held.start
                self.flat[at * self.segment_words : (at + 1) * self.segment_words] = self.parts.pop(s)
        return self

    def holds(self, h: np.ndarray) -> np.ndarray:
        segment, _ = self.place(h, self.segments)
        return (segment >= self.held.start) & (segment < self.held.stop)

    def level(self, h: np.ndarray, most: int = 50) -> np.ndarray:
        """Level of each n-gram; 0 for those of parts that aren't held."""
        self.join()
        out = np.zeros(len(h), np.int64)
        segment, key = self.place(h, self.segments)
        start = (segment - self.held.start) * self.segment_words
        alive = np.arange(len(h))
        if len(self.held) < self.segments:
            alive = np.flatnonzero(self.holds(h))
            key, start = key[alive], start[alive]
        for j in range(1, most):
            word, bits = self._probe(key, j)
            hit = self.flat[start + word] & bits == bits
            alive, key, start = alive[hit], key[hit], start[hit]
            out[alive] = j
            if not len(alive):
                break
        return out


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=_CHUNK):
        h, _ = tokens(text_bytes(batch.column("text")))
        code, u = pd.factorize(h)
        n = np.bincount(code, minlength=len(u))
        yield pa.RecordBatch.from_pydict({"h": pa.array(u.view(np.int64)), "c": pa.array(n.astype(np.int64))})


def _packed(key: np.ndarray, count: np.ndarray, kind: np.ndarray) -> dict[str, bytes]:
    """Ascending 40-bit keys with counts and kinds: low words of the gaps, and the mostly equal rest, compressed."""
    gap = np.diff(key, prepend=np.uint64(0))
    many = np.flatnonzero(count > 255)
    rest = [(gap >> np.uint64(32)).astype(np.uint8), np.where(count > 255, 0, count).astype(np.uint8), kind.astype(np.uint8), count[many].astype("<u8").view(np.uint8)]
    return {"low": gap.astype("<u4").tobytes(), "rest": zlib.compress(np.concatenate(rest).tobytes(), 1)}


def _unpacked(low: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, rest = np.frombuffer(low, "<u4"), np.frombuffer(zlib.decompress(rest), np.uint8)
    n = len(low)
    key = np.cumsum(low.astype(np.uint64) | rest[:n].astype(np.uint64) << np.uint64(32), dtype=np.uint64)
    count = rest[n : 2 * n].astype(np.int64)
    count[count == 0] = rest[3 * n :].view("<u8")
    return key, count, rest[2 * n : 3 * n]


def _token_levels(words: Filter | None, batch: pa.RecordBatch, code: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Level of each token, from the filter or, if it comes in passes, from what they wrote."""
    if words is None:
        return np.frombuffer(b"".join(batch.column("levels").to_pylist()), np.uint8).astype(np.int64)
    return words.level(seen)[code]


def _add_levels(words, names: list[str]):
    """The rows with the levels that one pass knows added: a byte for each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=_CHUNK):
            h, sizes = tokens(text_bytes(batch.column("text")))
            code, seen = pd.factorize(h)
            level = words.value.level(seen)[code].astype(np.uint8)
            old = b"".join(x or b"" for x in batch.column("levels").to_pylist())
            if old:
                level = level + np.frombuffer(old, np.uint8)
            ends = np.cumsum(sizes)
            own = [level[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(own, pa.binary())], [*names, "levels"])

    return run


def _before(per_token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the token before each has; the end token comes before the first."""
    out = np.concatenate(([0], per_token[:-1]))
    starts = np.cumsum(sizes) - sizes
    out[starts] = per_token[starts + sizes - 1]
    return out


def _pair_rows(words: Filter | None, segments: int):
    """The pairs of each chunk of texts, by segment of the filter to build."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=_CHUNK):
            h, sizes = tokens(text_bytes(batch.column("text")))
            gram, _ = pairs(h, sizes)
            kind = _before(_token_levels(words, batch, *pd.factorize(h)), sizes)
            segment, key = Filter.place(gram, segments)
            order = np.lexsort((key, segment))
            segment, key, kind = segment[order], key[order], kind[order]
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])))) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(key)))
            segment, key, kind = segment[first], key[first], kind[first]
            cut = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True]))) if len(key) else []
            rows = [{"segment": int(segment[x]), **_packed(key[x:y], count[x:y], kind[x:y])} for x, y in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int32()), ("low", pa.binary()), ("rest", pa.binary())]))

    return run


_PART = pa.schema([("segment", pa.int32()), ("bits", pa.binary()), ("types", pa.list_(pa.int64())), ("uses", pa.list_(pa.int64()))])
_PART_DDL = "segment int, bits binary, types array<bigint>, uses array<bigint>"


def _build(segments: int, segment_words: int):
    """Parts of the filter from packed n-grams. The rows of a segment follow each other."""

    def done(segment: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, count, kind = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, count, kind = key[order], count[order], kind[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, count, kind = key[first], np.add.reduceat(count, first), kind[first]
        own = Filter(segments, segment_words)
        own.put(segment, key, levels(count))
        types, uses = np.bincount(kind, minlength=64), np.bincount(kind, count, 64).astype(np.int64)
        return pa.RecordBatch.from_pylist([{"segment": segment, "bits": own.parts[segment].tobytes(), "types": types.tolist(), "uses": uses.tolist()}], _PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for segment, low, rest in zip(*(batch.column(c).to_pylist() for c in ("segment", "low", "rest")), strict=True):
                if segment != now:
                    if held:
                        yield done(now, held)
                    now, held = segment, []
                held.append(_unpacked(low, rest))
        if held:
            yield done(now, held)

    return run


def _word_rows(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment, key = Filter.place(batch.column("h").to_numpy().view(np.uint64), segments)
            count = batch.column("c").to_numpy()
            order = np.lexsort((key, segment))
            segment, key, count = segment[order], key[order], count[order]
            cut = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True]))) if len(key) else []
            rows = [{"segment": int(segment[x]), **_packed(key[x:y], count[x:y], np.zeros(y - x, np.uint8))} for x, y in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int32()), ("low", pa.binary()), ("rest", pa.binary())]))

    return run


def _filter(rows: DataFrame, packed, segments: int, bits: int, max_bits: int) -> tuple[list[Callable[[], Filter]], Filter, np.ndarray, np.ndarray]:
    """The filter of what ``packed`` makes of ``rows``, in passes of ``max_bits`` at most; its shape, of which no part is held, and the numbers of n-grams and of uses by kind."""
    segments = max(segments, -(-bits // max_bits))
    segment_words = -(-bits // segments // 64)
    shape = Filter(segments, segment_words, held=range(0, 1))
    parts = rows.mapInArrow(packed(segments), "segment int, low binary, rest binary").repartition("segment").sortWithinPartitions("segment")
    out = parts.mapInArrow(_build(segments, segment_words), _PART_DDL)
    step = -(-segments // -(-bits // max_bits))
    passes = [range(a, min(segments, a + step)) for a in range(0, segments, step)]
    shape.held = passes[0]
    out = materialize(out, "lm-filter")

    def collected(held: range) -> Filter:
        made = Filter(segments, segment_words, held=held)
        chosen = out.filter(F.col("segment").between(held.start, held.stop - 1)).select("segment", "bits")
        for part in chosen.toArrow().to_batches():
            for s, b in zip(*(part.column(i).to_pylist() for i in range(2)), strict=True):
                made.parts[s] = np.frombuffer(b, np.uint64)
        return made.join()

    kinds = out.select(F.posexplode(F.arrays_zip("types", "uses")).alias("kind", "x")).groupBy("kind").agg(F.sum("x.types").alias("types"), F.sum("x.uses").alias("uses"))
    counts = [np.zeros(64, np.int64), np.zeros(64, np.int64)]
    for row in kinds.collect():  # at most 64 rows
        counts[0][row.kind], counts[1][row.kind] = row.types, row.uses
    return [lambda held=held: collected(held) for held in passes], shape, *counts


def _log10(both: Filter, n: int, v: int, weight: np.ndarray, gram: np.ndarray, level: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 p of tokens by their pairs, which are in held segments, and the levels of their words and contexts."""
    single = (level_count(level) + 0.5) / (n + 0.5 * (v + 1))
    there = level_count(np.arange(64))[both.level(gram)] if n else np.zeros(len(gram))
    m, most = weight[before], np.maximum(level_count(before), 1.0)
    return np.log10(np.minimum(1.0, m * np.minimum(1.0, there / most) + (1 - m) * single))


_PROBES = [("rows", pa.binary()), ("sizes", pa.binary()), ("grams", pa.binary()), ("levels", pa.binary())]
_COUNTS = [("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]


def _ask(shape: Filter, words, heavy, n: int, v: int, name: str):
    """Of each chunk of texts the counts and base scores, as pass -1, and what it asks of each pass of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_h, heavy_c = heavy.value
        row, step = TaskContext.get().partitionId() << 33, len(shape.held)
        for batch in chunks(batches, limit=_ASKED):
            h, sizes = tokens(text_bytes(batch.column("text")))
            starts = np.cumsum(sizes) - sizes
            code, seen = pd.factorize(h)
            at = np.searchsorted(heavy_h, seen)
            at[at == len(heavy_h)] = 0
            heavy_seen = heavy_h[at] == seen if len(heavy_h) else np.zeros(len(seen), bool)
            logs = np.where(heavy_seen, np.log10((heavy_c[at] + 0.5) / (n + 0.5 * (v + 1))), 0.0) if len(heavy_h) else np.zeros(len(seen))
            known, base = heavy_seen[code], logs[code]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rare, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            edges = np.zeros(len(sizes) + 1, np.int32)
            if not known.all():
                # sorted by text and token, through one number for both
                both = np.sort(doc[~known] * len(seen) + code[~known])
                d, x = both // len(seen), seen[both % len(seen)]
                first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]))))
                rare, count = x[first], np.diff(np.concatenate((first, [len(x)])))
                edges = np.searchsorted(d[first], np.arange(len(sizes) + 1)).astype(np.int32)
            offsets = pa.array(edges, pa.int32())
            rows = row + np.arange(len(sizes))
            row += len(sizes)
            counts = [
                pa.array(rows), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)),
                pa.ListArray.from_arrays(offsets, pa.array(rare.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int64))),
            ]
            ids = batch.column(name)
            yield _answer(ids, counts, [pa.nulls(len(sizes), t) for _, t in _PROBES], np.full(len(sizes), -1))
            level = _token_levels(words.value, batch, code, seen).astype(np.uint8)
            before = _before(level, sizes).astype(np.uint8)
            gram, _ = pairs(h, sizes)
            part = Filter.place(gram, shape.segments)[0] // step
            order = np.argsort(part.astype(np.uint16) if shape.segments // step < 1 << 16 else part, kind="stable")
            part, gram, level, before, doc = part[order], gram[order], level[order], before[order], doc[order]
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            asked: list[list[bytes]] = [[], [], [], []]
            for a, b in zip(cut, cut[1:], strict=False):
                first = np.flatnonzero(np.concatenate(([True], doc[a + 1 : b] != doc[a : b - 1])))
                asked[0].append(zlib.compress(np.diff(rows[doc[a:b][first]], prepend=0).tobytes(), 1))
                asked[1].append(zlib.compress(np.diff(np.append(first, b - a)).astype("<u4").tobytes(), 1))
                asked[2].append(gram[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                asked[3].append(zlib.compress(level[a:b].tobytes() + before[a:b].tobytes(), 1))
            many = len(cut) - 1
            yield _answer(pa.nulls(many, ids.type), [pa.nulls(many, t) for _, t in _COUNTS], [pa.array(x, pa.binary()) for x in asked], part[cut[:-1]])

    return run


def _answer(ids: pa.Array, counts: list[pa.Array], probes: list[pa.Array], part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *counts, *probes, pa.array(part.astype(np.int32))], ["id", *(c for c, _ in _COUNTS), *(c for c, _ in _PROBES), "pass"])


def _tell(both, n: int, v: int, weight: np.ndarray):
    """(row, score): what the tokens of one pass add to the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sizes, grams, marks in zip(*(batch.column(c).to_pylist() for c, _ in _PROBES), strict=True):
                row = np.cumsum(np.frombuffer(zlib.decompress(rows), np.int64))
                size = np.frombuffer(zlib.decompress(sizes), "<u4").astype(np.int64)
                level, before = np.frombuffer(zlib.decompress(marks), np.uint8).reshape(2, -1).astype(np.int64)
                gram = np.zeros((len(level), 8), np.uint8)
                gram[:, :6] = np.frombuffer(grams, np.uint8).reshape(-1, 6)
                each = _log10(both.value, n, v, weight, gram.view("<u8")[:, 0], level, before)
                yield pa.RecordBatch.from_pydict({"row": pa.array(row), "score": pa.array(np.add.reduceat(each, np.cumsum(size) - size))})

    return run


def score(docs: DataFrame, learn: Column, bits_per_token: int = 8, max_bits: int = 1 << 28, max_word_bits: int = 1 << 29, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``; ``learn`` marks the training rows."""
    with Scratch() as own:
        found, kept = _scored(docs, learn, bits_per_token, max_bits, max_word_bits, id_col)
        own.release(*kept)
    return found


def _scored(docs: DataFrame, learn: Column, bits_per_token: int, max_bits: int, max_word_bits: int, id_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """What score returns, and the tables that it scans."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), "text", learn.alias("learn"))
    vocabulary = materialize(rows.filter("learn").select("text").mapInArrow(_unigrams, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-words")
    total = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (n >> 21) + 1)
    word_passes, _, _, _ = _filter(vocabulary, _word_rows, segments, max(1 << 16, bits_per_token * 3 * v), max_word_bits)
    words, texts = None, ["text", "levels"]
    if len(word_passes) == 1:
        words, texts = word_passes[0](), ["text"]
    else:
        rows = rows.withColumn("levels", F.lit(None).cast("binary"))
        ddl = f"id {rows.schema['id'].dataType.simpleString()}, text string, learn boolean, levels binary"
        for load in word_passes:
            held = spark.sparkContext.broadcast(load())
            before, rows = rows, materialize(rows.mapInArrow(_add_levels(held, ["id", "text", "learn"]), ddl), "lm-texts")
            discard(before)
            held.destroy()
    held = spark.sparkContext.broadcast(words)

    def packed(segments: int):
        def run(batches):
            yield from _pair_rows(held.value, segments)(batches)

        return run

    pair_passes, shape, types, uses = _filter(rows.filter("learn").select(*texts), packed, segments, max(1 << 16, bits_per_token * n), max_bits)
    weight = uses / np.maximum(1, uses + types)
    weight[0] = 0.0
    heavy_rows = vocabulary.filter(F.col("c") * HEAVY_SHARE >= n).toArrow()
    h = pc.fill_null(heavy_rows.column("h"), 0).to_numpy().view(np.uint64)
    order = np.argsort(h)
    heavy = spark.sparkContext.broadcast((h[order], heavy_rows.column("c").to_numpy()[order]))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, row long, n_tokens long, n_known long, base_score double, rare array<bigint>, times array<bigint>, rows binary, sizes binary, grams binary, levels binary, pass int"
    asked = materialize(rows.select("id", *texts).mapInArrow(_ask(shape, held, heavy, n, v, "id"), schema), "lm-probes", part="pass")
    held.destroy()
    told = []
    for i, load in enumerate(pair_passes):
        both = spark.sparkContext.broadcast(load())
        probes = asked.filter(F.col("pass") == i).select(*(c for c, _ in _PROBES))
        told.append(materialize(probes.mapInArrow(_tell(both, n, v, weight), "row long, score double").withColumn("pass", F.lit(i)), "lm-scores"))
        both.destroy()
    # added up in the order of the passes, so that reruns agree to the last bit
    scores = reduce(DataFrame.unionByName, told).groupBy("row").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("pass", "score"))), F.lit(0.0), lambda a, x: a + x["score"]).alias("score"))
    first = asked.filter(F.col("pass") == -1).select("id", *(c for c, _ in _COUNTS))
    each = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    counts = vocabulary.filter(F.col("c") * HEAVY_SHARE < n)
    found = each.join(counts, "h", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    logs = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))
    more = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * logs).alias("more_base"))
    out = first.drop("rare", "times").join(scores, "row").join(more, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
    return out, [asked, vocabulary, *told]
