"""Packing of documents into sequences by a configuration linear program.

The pieces' lengths form a histogram with at most ``capacity`` entries. A
configuration is a multiset of lengths that fits a sequence. The covering
program (every length covered as often as it occurs, fewest sequences) is solved
by multiplicative weights: each round prices the lengths, a knapsack dynamic
program finds the configuration of highest price, which is added as often as the
scarcest of its lengths allows, and lengths that are now covered get cheaper. The
fractional counts are scaled and rounded down, and the program is solved again for
the pieces left over. What many programs leave, and short pieces, go by best fit,
largest first, equal sequences being filled together.

Only the histogram reaches the driver, and only the list of configurations goes
back: both are bounded by the capacity, not by the documents. Pieces of a length
are numbered by sums over hash ranges and a window within each, and a piece's
number finds its configuration, its sequence and its place by binary search.

Documents longer than the capacity are cut into pieces of that length and a
rest. Defined results: null and empty texts are one piece, the end id alone.
Repeated rows and null ids are packed like any other row. Equal pieces may trade
places between reruns, never lengths. Other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from echosieve.llm.common import as_row, chunks, of_row, text_bytes, vocabulary_file
from echosieve.llm.token_count import byte_of_letter
from echosieve.storage import materialize


# --- tokens -----------------------------------------------------------------

#: Letters whose lower case and composition depend on nothing around them, and the marks that may follow a word.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([.,;:!?]*)")


def _little(ids: list[int]) -> bytes:
    """Numbers as little-endian 32-bit."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: Runs whose ids a worker keeps.
_KEPT = 400_000


class _Ids(dict):
    """Ids of a run of text without white space, as little-endian bytes; kept for repeated ones.

    The tokenizer cuts letters from other characters before it looks for pieces,
    so a run of plain letters and final marks goes to its model in two parts, in
    lower case, and the letters' ids serve every run with the same letters. Any
    other run goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary_file(path))
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_of_letter().items()}

    def _keep(self, run: bytes, ids: bytes) -> bytes:
        if len(run) <= 64:
            if len(self) > _KEPT:
                self.clear()
            self[run] = ids
        return ids

    def _part(self, lower: bytes) -> bytes:
        """Ids of letters in lower case, or of marks."""
        ids = self.get(lower)
        if ids is None:
            known = lower.decode() if lower.isascii() else lower.decode("latin-1").translate(self.letters)
            ids = self._keep(lower, _little([t.id for t in self.model.tokenize(known)]))
        return ids

    def __missing__(self, run: bytes) -> bytes:
        if len(run) <= 64:
            if run.isalpha():  # true of ASCII letters only
                lower = run.lower()
                ids = self._part(lower)
                return ids if lower == run else self._keep(run, ids)
            if m := _PLAIN.fullmatch(run.decode("utf-8", "replace")):
                ids = self._part(m[1].lower().encode())
                return self._keep(run, ids + self._part(m[2].encode()) if m[2] else ids)
        return self._keep(run, _little(self.tokenizer.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids))


_known: dict[str, _Ids] = {}


def token_bytes(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text. The tokenizer's words never cross white space, so each run between ASCII white space is encoded once and its ids reused."""
    if path not in _known:
        _known[path] = _Ids(path)
    ids = _known[path].__getitem__
    for x in texts:
        yield b"".join(map(ids, x.split()))


def _pieces(path: str, capacity: int, end_id: int, names: list[str]):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(token_bytes(text_bytes(batch.column("text")), path)):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in names), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [*names, "piece", "start", "length", "ids_crc32"]
            )

    return run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_col, "text").mapInArrow(_pieces(vocabulary, capacity, end_id, [id_col]), schema)


# --- the program --------------------------------------------------------------

def _price(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """Number of each size (ascending) in the configuration of highest price: a knapsack, by the best value of every capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        got = best[c - sizes[: fits[c]]] + price[: fits[c]]
        k = int(got.argmax())
        best[c], pick[c] = (got[k], k) if got[k] >= best[c - 1] else (best[c - 1], -2)
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0 and pick[c] != -1:
        if pick[c] == -2:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return out


def fractional(sizes: np.ndarray, count: np.ndarray, capacity: int, rounds: int, rate: float) -> list[tuple[np.ndarray, float]]:
    """Configurations and their fractional numbers for the covering program, by multiplicative weights.

    A size's weight is its share of the capacity, times exp(-rate) for every time
    that its count is covered.
    """
    weight, covered = sizes / capacity, np.zeros(len(sizes))
    found: dict[bytes, list] = {}
    for _ in range(rounds):
        config = _price(sizes, weight, capacity)
        config = np.minimum(config, count)
        used = config > 0
        times = float((count[used] / config[used]).min())
        found.setdefault(config.tobytes(), [config, 0.0])[1] += times
        share = times * config / count
        covered += share * count
        weight = weight * np.exp(-rate * share)
        weight /= weight.max()
    scale = float((count * sizes).sum() / (covered * sizes).sum())
    return [(config, times * scale) for config, times in found.values()]


class _Bins:
    """Sequences under way, equal ones together, by the room that they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, bool)

    def put(self, config: dict[int, int], copies: int) -> None:
        room = self.capacity - sum(k * n for k, n in config.items())
        self.groups[room].append((config, copies))
        self.some[room] = True

    def best_fit(self, k: int, n: int) -> None:
        """Place n pieces of length k, each where the least room is left."""
        while n:
            room = k + int(self.some[k:].argmax())
            if not self.some[room]:
                room, config, copies = self.capacity, {}, n
            else:
                config, copies = self.groups[room].pop()
                self.some[room] = bool(self.groups[room])
            each = min(room // k, n)
            full = min(copies, n // each)
            self.put({**config, k: config.get(k, 0) + each}, full)
            if config and copies > full:
                self.put(config, copies - full)
            n -= full * each


def _fill(open_: list[tuple[int, list[int]]], left: dict[int, int], bins: _Bins, units: int, rounds: int, rate: float, full: float) -> int:
    """One program over sizes and their lengths; its configurations that fill at least the share ``full`` of a sequence, rounded down and placed; how many pieces that were."""
    sizes = np.array([c for c, _ in open_], np.int64)
    counts = np.array([sum(left[k] for k in lengths) for _, lengths in open_], np.int64)
    lengths_of, before = dict(open_), int(counts.sum())
    found = fractional(sizes, counts, units, rounds, rate)
    for config, times in sorted(found, key=lambda x: (-int((x[0] * sizes).sum()), -x[1])):
        used = config > 0
        copies = min(int(times), int((counts[used] // config[used]).min()))
        if not copies or int((config * sizes).sum()) < full * units:
            continue
        counts = counts - copies * config
        # every slot takes its size's lengths in turn; where a slot goes on to another length, the copies are divided
        slots = []
        for c, n in zip(sizes[used].tolist(), config[used].tolist(), strict=True):
            for _ in range(n):
                run, need = [], copies
                while need:
                    k = lengths_of[c][0]
                    n_k = min(need, left[k])
                    run.append((k, n_k))
                    left[k] -= n_k
                    need -= n_k
                    if not left[k]:
                        lengths_of[c].pop(0)
                slots.append(run)
        while slots[0]:
            n = min(run[0][1] for run in slots)
            bins.put(dict(Counter(run[0][0] for run in slots)), n)
            slots = [([(run[0][0], run[0][1] - n)] if run[0][1] > n else []) + run[1:] for run in slots]
    return before - int(counts.sum())


def waiting(histogram: dict[int, int], small: int, share: float) -> int:
    """The greatest length, at most ``small``, up to which pieces hold at most ``share`` of all tokens."""
    total, held, most = sum(k * n for k, n in histogram.items()), 0, 0
    for k in range(1, small + 1):
        held += k * histogram.get(k, 0)
        if held > share * total:
            break
        most = k
    return most


def solve(
    histogram: dict[int, int], capacity: int, grain: int = 1, small: int = 200, small_share: float = 0.05, rounds: int = 150, rate: float = 0.3, full: float = 0.999, rest: float = 0.02, programs: int = 6
) -> list[tuple[dict[int, int], int]]:
    """(length -> number, copies) of configurations that hold the histogram exactly.

    The program is over sizes in units of ``grain``, rounded up. It is solved again
    for the pieces that it leaves, until they are at most the share ``rest`` of its
    pieces, it places no more, or ``programs`` have run. Pieces up to ``small``, as
    far as they hold at most ``small_share`` of the tokens, wait for the room that
    rounding leaves, and best fit places them and the rest.
    """
    left = {k: n for k, n in histogram.items() if n}
    bins = _Bins(capacity)
    if n := left.pop(capacity, 0):
        bins.put({capacity: 1}, n)
    small = waiting(left, small, small_share)
    by_size: dict[int, list[int]] = {}
    for k in sorted(left, reverse=True):
        if k > small and -(-k // grain) * grain <= capacity:
            by_size.setdefault(-(-k // grain), []).append(k)
    pieces = open_pieces = sum(left[k] for lengths in by_size.values() for k in lengths)
    for _ in range(programs):
        open_ = sorted((c, lengths) for c, lengths in by_size.items() if lengths)
        if open_pieces <= rest * pieces or not (placed := _fill(open_, left, bins, capacity // grain, rounds, rate, full)):
            break
        open_pieces -= placed
    for k in sorted(left, reverse=True):
        bins.best_fit(k, left[k])
    return [x for groups in bins.groups for x in groups]


def runs(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and range of piece numbers: sequences, pieces in each, and the first piece's place."""
    rows, taken, sequence = [], Counter(), 0
    for config, copies in plan:
        offset = 0
        for k in sorted(config, reverse=True):
            rows.append((k, taken[k], config[k], sequence, offset))
            taken[k] += config[k] * copies
            offset += k * config[k]
        sequence += copies
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), cols, strict=True))


_SHIFT = 1 << 44


def _place(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        keys = r["length"] * _SHIFT + r["first"]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(keys, length * _SHIFT + number, "right") - 1
            if not len(at):
                continue
            k = number - r["first"][at]
            sequence = r["sequence"][at] + k // r["each"][at]
            offset = r["offset"][at] + k % r["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = 4096, range_rows: int = 4096, **how) -> DataFrame:
    """``cut`` (any columns, with ``length``) and the columns ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    rows = cut.select(as_row(names), F.col("length").cast("long").alias("length"))
    rows = materialize(rows.withColumn("salt", F.xxhash64("row")), "pieces")
    histogram = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    ranges = min(4096, max(1, -(-sum(histogram.values()) // range_rows)))
    rows = rows.withColumn("range", F.pmod("salt", F.lit(ranges)))
    counts = rows.groupBy("length", "range").count()
    before = counts.select("length", "range", (F.sum("count").over(Window.partitionBy("length").orderBy("range")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "range").orderBy("salt")) - 1
    numbered = rows.withColumn("within", within).join(before, ["length", "range"]).withColumn("number", (F.col("before") + F.col("within")).cast("long"))
    held = spark.sparkContext.broadcast(runs(solve(histogram, capacity, **how)))
    schema = T.StructType([rows.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = numbered.select("row", "length", "number").mapInArrow(_place(held, ["row"]), schema)
    return placed.select(*of_row(names), "sequence_id", "offset")
