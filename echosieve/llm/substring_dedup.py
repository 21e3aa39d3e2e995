"""Removal of repeated word windows with a count-min prefilter.

Documents are dealt once to chunks of about ``chunk_bytes`` and written in buckets of
chunks, so every later pass finds a chunk and what is known about it without
another shuffle of the texts.

First pass: every chunk counts its windows in a count-min sketch of two rows of
cells and sends the cells that it uses, as the gaps between them, to the tasks
that own the segments of the sketch. Segments merge by addition; the answer to a
chunk is one bit for each cell that it sent: counted once or more often. Counts
are never underestimated, so a window whose two cells aren't both counted more
often is unique. The sketch is never gathered: it has ``cells_per_word`` cells a
row for every 8 bytes of the corpus at every size, in segments of bounded size.

Second pass: of the other windows a chunk sends each once, by an 80-bit hash, with
the smallest document that has it there. The tasks that own the hashes find the
smallest document of all, and answer with one bit for each window: whether an
earlier document has it elsewhere. A window of a third of all documents is thus one
row a chunk. Third pass: windows so marked, and those behind the smallest document
of their own chunk, mark their words; marked words go.

Work and bytes sent are in proportion to the windows; a task holds one chunk, one
segment or one bucket of hashes, and one text at least. Nothing is broadcast or
collected. Two different windows among m that pass the prefilter are taken for
one with a chance of about m**2 / 2**81 in all, plus that of equal 64-bit hashes of
two of v different words, v**2 / 2**65.

Windows are judged on the input. Defined results: null and empty texts have no
words; texts shorter than a window lose nothing. Words are bytes, so a text need
not be valid UTF-8. Rows with the same id are one document: they don't remove from
each other. A null id comes after all others. Repeated rows are returned each
time. Other columns pass through, whatever their names; ``es_n_words`` and
``es_n_removed`` are replaced if the input has them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echosieve.llm.common import as_row, as_strings, chunks, of_row, text_bytes, word_hashes
from echosieve.storage import bucketed

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LAST = 2**63 - 1
#: Bytes of text for each word, about; it only sizes the sketch.
_BYTES = 8
#: Windows of the corpus for each segment of the sketch, and for each bucket of the exact pass.
_SEGMENT_WINDOWS, _BUCKET_WINDOWS = 1 << 21, 1 << 22
#: Bytes of text for each file of the dealt documents, and texts of so many bytes are split to words at once.
_FILE_BYTES, _AT_ONCE = 1 << 27, 4 << 20


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, built from runs of powers of two."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, length, run, span, power = np.zeros(n, np.uint64), 0, h, 1, base
    left = size
    while left:
        if left & 1:
            scale = np.uint64(pow(int(base), length, 2**64))
            out = out + run[length : length + n] * scale
            length += span
        left >>= 1
        if left:
            run = run[:-span] + run[span:] * power
            power = power * power
            span *= 2
    return _final(out)


def windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, text number, place) of every window that lies within one text."""
    parts = [x.split() for x in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    h = word_hashes(parts, int(counts.sum()))
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = place + size <= counts[doc]
    n = max(0, len(h) - size + 1)
    whole = whole[:n]
    with np.errstate(over="ignore"):
        a, b = (window_hashes(h, size, base)[whole] for base in _BASES)
    return a, b, doc[:n][whole], place[:n][whole]


def _gaps_width(mean: float) -> int:
    return 1 if mean < 100 else 2 if mean < 25_000 else 4


def _steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers as gaps of 1, 2 or 4 bytes; the largest value of a gap adds up with what follows."""
    d = np.diff(ascending.astype(np.int64), prepend=0)
    width = _gaps_width((int(ascending[-1]) + 1) / len(ascending)) if len(ascending) else 1
    top = 256**width - 1
    end = np.cumsum(d // top + 1)
    out = np.full(int(end[-1]) if len(end) else 0, top, f"<u{width}")
    out[end - 1] = d % top
    return bytes([width]) + out.tobytes()


def _ids(gaps: bytes) -> np.ndarray:
    width = gaps[0]
    g = np.frombuffer(gaps, f"<u{width}", offset=1) if len(gaps) > 1 else np.zeros(0, np.uint8)
    return np.cumsum(g, dtype=np.int64)[g < 256**width - 1]


class Sketch:
    """The shape of the count-min sketch: two rows of cells, in segments."""

    def __init__(self, words: int, cells_per_word: int, parts: int):
        self.segments = max(parts, -(-words // _SEGMENT_WINDOWS))
        self.width = max(1 << 10, -(-cells_per_word * words // self.segments))
        self.cells = self.segments * self.width

    def used(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells that windows use, ascending; the cell of each window; how often each is used; where segments start among them, and the end."""
        cell, at, n = np.unique((h >> np.uint64(8)) % np.uint64(self.cells), return_inverse=True, return_counts=True)
        segment = cell // np.uint64(self.width)
        cut = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True]))) if len(cell) else np.zeros(1, np.int64)
        return cell, at, n, cut


def _cut(part: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values of ascending numbers."""
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
    return list(zip(cut, cut[1:], strict=False))


def _chunk_windows(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, row of the table, place) of all windows of a chunk; few texts are split to words at once."""
    found, before = [], 0
    for batch in chunks(table.to_batches(), limit=_AT_ONCE):
        a, b, doc, place = windows(text_bytes(batch.column("text")), size)
        found.append((a, b, (doc + before).astype(np.int32), place.astype(np.int32)))
        before += batch.num_rows
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


_CELLS = pa.schema([("segment", pa.int64()), ("chunk", pa.int32()), ("used", pa.binary()), ("again", pa.binary())])
_MASKS = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("part", pa.int64()), ("bits", pa.binary())])
_KEYS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("at", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _count(size: int, sketch: Sketch):
    """The cells of a chunk, by segment; the kind of row of the sketch is part of the segment's number."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = []
        for kind, h in enumerate(_chunk_windows(table, size)[:2]):
            cell, _, n, cut = sketch.used(h)
            for x, y in zip(cut, cut[1:], strict=False):
                segment = int(cell[x]) // sketch.width
                again = np.flatnonzero(n[x:y] > 1)
                local = (cell[x:y] - np.uint64(segment * sketch.width)).astype(np.int64)
                rows.append({"segment": 2 * segment + kind, "chunk": key[0].as_py(), "used": _steps(local), "again": np.stack((again, n[x:y][again])).astype("<u4").tobytes()})
        return pa.Table.from_pylist(rows, _CELLS)

    return run


def _merge(width: int):
    """For each chunk a bit for each cell that it sent: whether that was counted more than once. The rows of a segment follow each other."""

    def done(segment: int, held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(width, np.int32)
        for _, used, again in held:
            ids = _ids(used)
            count[ids] += 1
            k, n = np.frombuffer(again, "<u4").reshape(2, -1)
            count[ids[k]] += n.astype(np.int32) - 1
        for x in range(0, len(held), 256):
            rows = [{"chunk": chunk, "kind": segment % 2, "part": segment // 2, "bits": np.packbits(count[_ids(used)] > 1).tobytes()} for chunk, used, _ in held[x : x + 256]]
            yield pa.RecordBatch.from_pylist(rows, _MASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for segment, chunk, used, again in zip(*(batch.column(c).to_pylist() for c in _CELLS.names), strict=True):
                if segment != now and held:
                    yield from done(now, held)
                    held = []
                now = segment
                held.append((chunk, used, again))
        if held:
            yield from done(now, held)

    return run


def _bits(known: pa.Table, kind: int) -> dict[int, np.ndarray]:
    rows = zip(*(known.column(c).to_pylist() for c in ("kind", "part", "bits")), strict=True)
    return {part: np.frombuffer(bits, np.uint8) for k, part, bits in rows if k == kind}


def _maybe(a: np.ndarray, b: np.ndarray, sketch: Sketch, known: pa.Table) -> np.ndarray:
    """Which windows of a chunk the sketch estimates as repeated."""
    out = np.ones(len(a), bool)
    for kind, h in enumerate((a, b)):
        bits = _bits(known, kind)
        cell, at, _, cut = sketch.used(h)
        more = [np.unpackbits(bits[int(cell[x]) // sketch.width], count=y - x).astype(bool) for x, y in zip(cut, cut[1:], strict=False)]
        if more:
            out &= np.concatenate(more)[at]
    return out


class Candidates:
    """The windows of a chunk that may be repeated: each once, by bucket, with the smallest document of the chunk that has it."""

    def __init__(self, table: pa.Table, known: pa.Table, size: int, sketch: Sketch, buckets: int):
        a, b, doc, place = _chunk_windows(table, size)
        some = _maybe(a, b, sketch, known)
        a, b, self.doc, self.place = a[some], (b[some] >> np.uint64(48)).astype(np.uint16), doc[some], place[some]
        self.id = table.column("id").to_numpy()[self.doc]
        bucket = ((a >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.id, b, a, bucket))
        a, b, bucket = a[order], b[order], bucket[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        self.a, self.b, self.bucket, self.least = a[new], b[new], bucket[new], self.id[order][new]
        #: the number of each window's distinct one
        self.of = np.empty(len(a), np.int64)
        self.of[order] = np.cumsum(new) - 1


def _send(size: int, sketch: Sketch, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        c = Candidates(table, known, size, sketch, buckets)
        rows = []
        for x, y in _cut(c.bucket):
            ids, at = np.unique(c.least[x:y], return_inverse=True)
            keys = c.a[x:y].tobytes() + c.b[x:y].tobytes()
            rows.append({"bucket": int(c.bucket[x]), "chunk": key[0].as_py(), "keys": keys, "ids": zlib.compress(np.diff(ids, prepend=0).tobytes(), 1), "at": at.astype("<u2" if len(ids) <= 1 << 16 else "<u4").tobytes()})
        return pa.Table.from_pylist(rows, _KEYS)

    return run


def _elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk a bit for each window that it sent: whether a smaller document elsewhere has it. The rows of a bucket follow each other."""

    def done(bucket: int, held: list[tuple[int, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        sizes = [len(keys) // 10 for _, keys, _, _ in held]
        a = np.concatenate([np.frombuffer(keys, "<u8", n) for (_, keys, _, _), n in zip(held, sizes, strict=True)])
        b = np.concatenate([np.frombuffer(keys, "<u2", n, 8 * n) for (_, keys, _, _), n in zip(held, sizes, strict=True)])
        least = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(ids), "<i8"))[np.frombuffer(at, f"<u{len(at) // n}")] for (_, _, ids, at), n in zip(held, sizes, strict=True)])
        order = np.lexsort((least, b, a))
        a, b, least = a[order], b[order], least[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        behind = np.empty(len(a), bool)
        behind[order] = least > least[new][np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        rows = [{"chunk": chunk, "kind": 2, "part": bucket, "bits": np.packbits(behind[end - n : end]).tobytes()} for (chunk, _, _, _), n, end in zip(held, sizes, ends, strict=True) if behind[end - n : end].any()]
        yield pa.RecordBatch.from_pylist(rows, _MASKS)

    now, held = None, []
    for batch in batches:
        for bucket, chunk, keys, ids, at in zip(*(batch.column(c).to_pylist() for c in _KEYS.names), strict=True):
            if bucket != now and held:
                yield from done(now, held)
                held = []
            now = bucket
            held.append((chunk, keys, ids, at))
    if held:
        yield from done(now, held)


def _remove(size: int, sketch: Sketch, buckets: int):
    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        c = Candidates(table, known, size, sketch, buckets)
        behind = np.zeros(len(c.a), bool)
        bits = _bits(known, 2)
        for x, y in _cut(c.bucket):
            if (found := bits.get(int(c.bucket[x]))) is not None:
                behind[x:y] = np.unpackbits(found, count=y - x)
        gone = behind[c.of] | (c.id > c.least[c.of])
        doc, place = c.doc[gone], c.place[gone]
        order = np.argsort(doc, kind="stable")
        doc, place = doc[order], place[order]
        first = np.searchsorted(doc, np.arange(table.num_rows + 1))
        texts, total, lost, at = [], [], [], 0
        for batch in chunks(table.to_batches(), limit=_AT_ONCE):
            for text in text_bytes(batch.column("text")):
                words = text.split()
                total.append(len(words))
                own = place[first[at] : first[at + 1]]
                at += 1
                if len(own):
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, own, 1)
                    np.add.at(marks, own + size, -1)
                    keep = np.cumsum(marks)[:-1] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                lost.append(total[-1] - len(words))
                texts.append(b" ".join(words))
        return pa.Table.from_arrays([table.column("row"), as_strings(texts), pa.array(total, pa.int64()), pa.array(lost, pa.int64())], ["row", "text", "n_words", "n_removed"])

    return run


def dealt(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int, int]:
    """``docs`` as (chunk, id, text, row) in buckets of chunks, the number of buckets, and about how many words there are."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // _FILE_BYTES)
    many = max(2 * files, total // chunk_bytes)
    own = as_row([c for c in docs.columns if c != "text"])
    # rows without an id are dealt one by one, so copies among them don't meet in one chunk
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", "text"))
    rows = docs.select(F.pmod(deal, F.lit(many)).cast("int").alias("chunk"), F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("id"), "text", own)
    return bucketed(rows, "window-texts", "chunk", files), files, total // _BYTES + 1


def drop_repeated_windows(docs: DataFrame, size: int = 13, cells_per_word: int = 4, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``), ``text`` as its kept words joined by spaces, and ``es_n_words`` and ``es_n_removed``."""
    rows, files, n = dealt(docs, chunk_bytes)
    sketch = Sketch(n, cells_per_word, files)
    buckets = max(files, -(-n // _BUCKET_WINDOWS))
    texts = rows.select("chunk", "id", "text").groupBy("chunk")
    cells = rows.select("chunk", "text").groupBy("chunk").applyInArrow(_count(size, sketch), _ddl(_CELLS))
    cells = cells.repartition("segment").sortWithinPartitions("segment")
    masks = bucketed(cells.mapInArrow(_merge(sketch.width), _ddl(_MASKS)), "window-masks", "chunk", files)
    keys = texts.cogroup(masks.groupBy("chunk")).applyInArrow(_send(size, sketch, buckets), _ddl(_KEYS))
    found = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_elsewhere, _ddl(_MASKS))
    known = bucketed(masks.unionByName(found), "window-answers", "chunk", files)
    out = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    kept = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_remove(size, sketch, buckets), out)
    names = [c for c in docs.columns if c not in ("text", "es_n_words", "es_n_removed")]
    return kept.select(*of_row(names), "text", F.col("n_words").alias("es_n_words"), F.col("n_removed").alias("es_n_removed"))
