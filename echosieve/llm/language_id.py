"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the elementwise
product of its letters' vectors, each rotated by its place; a text is the sum of
its n-grams; a language's prototype is the sum over its training texts. A text
gets the language whose prototype has the largest cosine with it.

A sum of n-gram vectors is linear in the n-gram counts, so texts are counted
first and multiplied with the table of n-gram vectors in blocks.

Letters are lower-cased; every letter of any script has a vector of its own, drawn
from its code point; every run of other characters, and each end of the text, is
one border symbol. ``und`` with score 0 is given for null, for texts without a
letter and when nothing was learned. A zero or negative cosine scores 0. Equal
cosines go to the first language by code point. Bytes that aren't valid UTF-8 are
borders. Rows with a null label teach nothing; repeated rows count each time. A text
of any length is handled whole. Other columns pass through.

The only thing sent to the workers is the prototypes: languages x ``dim``
numbers, with the number of languages checked against ``max_langs``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echosieve.llm.common import as_row, chunks, decoded, of_row

#: Bits of a code point, and grams whose vectors are held at once.
_BITS, _AT_ONCE = 21, 2048


@cache
def _letter_symbol() -> np.ndarray:
    """Symbol of each code point: itself for a letter, else 0, the border."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            out[c] = c
    out[0xFFFD] = 0
    return out


class _Letters(dict):
    """Random vector of each symbol, drawn from a seed and the symbol; emptied when it grows too large."""

    def __init__(self, dim: int, seed: int):
        super().__init__()
        self.dim, self.seed = dim, seed

    def __missing__(self, symbol: int) -> np.ndarray:
        if len(self) > 20_000:
            self.clear()
        out = self[symbol] = np.random.default_rng([self.seed, symbol]).choice(np.array([-1, 1], np.int8), self.dim)
        return out


_letters: dict[tuple[int, int], _Letters] = {}


def letter_vector(symbol: int, dim: int, seed: int) -> np.ndarray:
    return _letters.setdefault((dim, seed), _Letters(dim, seed))[symbol]


def gram_vectors(grams: np.ndarray, dim: int, n: int, seed: int) -> np.ndarray:
    """(grams, dim) n-gram vectors: products of rotated letter vectors."""
    out = np.ones((len(grams), dim), np.int8)
    for place in range(n):
        symbols, at = np.unique(grams >> (_BITS * (n - 1 - place)) & ((1 << _BITS) - 1), return_inverse=True)
        table = np.stack([np.roll(letter_vector(int(c), dim, seed), n - 1 - place) for c in symbols])
        out *= table[at]
    return out


def gram_counts(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of each n-gram of each text that has letters; ``n`` is 3 at most."""
    docs, grams, counts = [], [], []
    symbol = _letter_symbol()
    for i, text in enumerate(texts):
        if not text:
            continue
        s = symbol[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        if not s.any():
            continue
        s = np.concatenate(([0], s, [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        g = np.zeros(max(1, len(s) - n + 1), np.int64)
        for place in range(n):
            part = s[place : place + len(g)]
            g = g << _BITS | np.pad(part, (0, len(g) - len(part)))
        ids, found = np.unique(g, return_counts=True)
        docs.append(np.full(len(ids), i))
        grams.append(ids)
        counts.append(found)
    if not docs:
        return (np.zeros(0, int),) * 3
    return np.concatenate(docs), np.concatenate(grams), np.concatenate(counts)


def _bundle(dim: int, n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, np.ndarray] = {}
        for batch in chunks(batches, limit=2 << 20):
            langs, own = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            docs, grams, counts = gram_counts(decoded(batch.column("text")), n)
            used, column = np.unique(grams, return_inverse=True)
            total = np.zeros((len(langs), len(used)))
            np.add.at(total, (own[docs], column), counts)
            for a in range(0, len(used), _AT_ONCE):
                part = total[:, a : a + _AT_ONCE] @ gram_vectors(used[a : a + _AT_ONCE], dim, n, seed).astype(np.float64)
                for k, lang in enumerate(langs.tolist()):
                    by_lang[lang] = by_lang.get(lang, 0) + part[k].astype(np.int64)
        for lang, bundle in by_lang.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dim, "place": pa.array(range(dim), pa.int32()), "total": pa.array(bundle, pa.int64())})

    return run


def learn(labelled: DataFrame, dim: int = 1024, n: int = 3, seed: int = 7, max_langs: int = 2000) -> dict[str, np.ndarray]:
    """Prototype of each language of (text, lang). Partitions bundle their rows; bundles add up."""
    rows = labelled.select("text", "lang").filter("lang is not null and text is not null")
    parts = rows.mapInArrow(_bundle(dim, n, seed), "lang string, place int, total long")
    sums = parts.groupBy("lang", "place").agg(F.sum("total").alias("total"))
    out: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        if r.lang not in out and len(out) == max_langs:
            raise ValueError(f"more than {max_langs} languages")
        out.setdefault(r.lang, np.zeros(dim))[r.place] = r.total
    return dict(sorted(out.items()))


def few_rows(batches: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most)


def _compare(prototypes: dict[str, np.ndarray], dim: int, n: int, seed: int, names: list[str]):
    langs = list(prototypes)
    units = np.stack([p / (np.linalg.norm(p) or 1.0) for p in prototypes.values()]).astype(np.float32) if langs else np.zeros((0, dim), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(chunks(batches, limit=1 << 20)):
            texts = decoded(batch.column("text"))
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            docs, grams, counts = gram_counts(texts, n) if langs else (np.zeros(0, int),) * 3
            if len(docs):
                rows, row = np.unique(docs, return_inverse=True)
                used, column = np.unique(grams, return_inverse=True)
                bundles = np.zeros((len(rows), dim), np.float32)
                order = np.argsort(column, kind="stable")
                row, column, counts = row[order], column[order], counts[order]
                for a in range(0, len(used), _AT_ONCE):
                    x, y = np.searchsorted(column, (a, a + _AT_ONCE))
                    vectors = gram_vectors(used[a : a + _AT_ONCE], dim, n, seed).astype(np.float32)
                    dense = np.zeros((len(rows), len(vectors)), np.float32)
                    dense[row[x:y], column[x:y] - a] = counts[x:y]
                    bundles += dense @ vectors
                size = np.linalg.norm(bundles, axis=1)
                cosine = (bundles @ units.T) / np.where(size > 0, size, 1)[:, None]
                best = cosine.argmax(1)
                pred[rows] = np.array(langs, object)[best]
                score[rows] = np.clip(cosine[np.arange(len(rows)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = 1024, n: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` (with ``text``) and the columns ``lang_pred`` and ``score``, in place of any of these names."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(as_row([c for c in names if c != "text"]), "text")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_compare(prototypes, dim, n, seed, ["row", "text"]), schema).select(*of_row(names), "lang_pred", "score")
