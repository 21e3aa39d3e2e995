"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. A node's failure link leads to the node
reached after greedily popping the pieces that its own path starts with, and the
number of pieces popped is stored beside it. Reading a word then takes one pass:
on a missing child the stored count is added and the link followed. No piece is
built.

A word is a run of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, closed by a mark;
pieces that end a word hold the mark. A word that holds a byte sequence no piece
covers is one unknown token. Null and empty texts have no words and no tokens.
Rows are independent: repeated or null ids don't matter, and other columns pass
through. Counts of repeated words are kept, up to a bounded number of words.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from echosieve.llm.common import as_row, chunks, of_row, text_bytes, vocabulary_file

#: Closes a word; can't occur inside one.
MARK = b" "


class Automaton:
    """Trie of the pieces with failure links and popped counts."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                at = to
            whole[at] = at > 0
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if whole[v]:
                        self.link[v], self.popped[v] = 0, 1
                        continue
                    at, count = self.link[u], self.popped[u]
                    while at >= 0 and c not in self.next[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[v], self.popped[v] = self.next[at][c], count
            level = below

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of a word, its mark included; 1 if a part isn't covered."""
        at = total = 0
        step, link, popped = self.next, self.link, self.popped
        for c in word:
            to = step[at].get(c)
            while to is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 1
                to = step[at].get(c)
            at = to
        while at > 0:
            total += popped[at]
            at = link[at]
        return total if at == 0 else 1


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str, ending: str = "</w>") -> list[bytes]:
    """Pieces of a byte-level vocabulary file of ``tokenizers``, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {x["content"] for x in made.get("added_tokens", []) if x.get("special")}
    letters = byte_of_letter()
    out = []
    for piece in made["model"]["vocab"]:
        if piece not in special:
            ends = piece.endswith(ending)
            body = piece[: len(piece) - len(ending)] if ends else piece
            out.append(bytes(letters[c] for c in body) + MARK * ends)
    return out


_loaded: dict[tuple[str, str], Automaton] = {}


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word + MARK)
        if len(word) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[word] = n
        return n


def _count(path: str, ending: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, ending) not in _loaded:
            _loaded[path, ending] = Automaton(load_pieces(vocabulary_file(path), ending))
        get = _Counts(_loaded[path, ending]).__getitem__
        for batch in chunks(batches):
            each = [x.lower().split() for x in text_bytes(batch.column("text"))]
            words = pa.array(np.array([len(x) for x in each], np.int64))
            pieces = pa.array(np.array([sum(map(get, x)) for x in each], np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), words, pieces], [*names, "n_words", "n_pieces"])

    return run


def count_pieces(docs: DataFrame, vocabulary: str, ending: str = "</w>", keep_text: bool = True) -> DataFrame:
    """``docs`` (with ``text``) and the columns ``n_words`` and ``n_pieces``, in place of any of these names."""
    names = [c for c in docs.columns if c not in ("n_words", "n_pieces") and (keep_text or c != "text")]
    rows = docs.select(as_row([c for c in names if c != "text"]), "text")
    kept = ["row", *(["text"] if keep_text else [])]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType())])
    return rows.mapInArrow(_count(vocabulary, ending, kept), schema).select(*of_row(names), "n_words", "n_pieces")
