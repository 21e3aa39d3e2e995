"""From files to tokens to blocks. One Arrow pass each; a file that can't be tokenized gives an error and no tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echosieve.languages import registry
from echosieve.languages import tokens as k
from echosieve.languages.tokens import ScanError, Token
from echosieve.operators.numbering import attach_numbers
from echosieve.sources.encoding import to_utf8
from echosieve.storage import materialize

_TOKEN = "struct<kind:string,text:string,line:int,col:int>"
TOKENS = f"file_id int, path string, language string, tokens array<{_TOKEN}>, error struct<message:string,line:int,col:int>"
BLOCKS = "file_id int, path string, language string, name string, start_line int, start_col int, end_line int, end_col int, token_start int, token_end int, struct_ids array<bigint>, text_ids array<bigint>"


def structural_id(token: Token) -> int:
    return k.GENERIC.get(token.kind, k.NUMBER_OF.get(token.kind, 0))


def text_id(token: Token) -> int:
    """Names and literals by their text alone, other tokens by their kind. A 64-bit hash, the same in every file and run."""
    mark = f"t:{token.text}" if token.kind in k.GENERIC else f"o:{token.kind}"
    return xxhash.xxh3_64_intdigest(mark.encode("utf-8", "surrogatepass")) - (1 << 63)


def normalize(tokens: list[Token], language: registry.LanguageSpec, by_text: bool = False) -> list[tuple[int, int]]:
    """(id, place among all tokens) of the tokens that count."""
    own = text_id if by_text else structural_id
    return [(own(t), i) for i, t in enumerate(tokens) if t.kind not in language.strip]


def _read(content: bytes | None, encoding: str) -> bytes:
    return to_utf8(content or b"", encoding)


def _tokenize(encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                language = registry.by_name(row["language"])
                out = {"file_id": row["file_id"], "path": row["path"], "language": row["language"], "tokens": None, "error": None}
                try:
                    out["tokens"] = [t._asdict() for t in language.tokenize(_read(row["content"], encoding))] if language else None
                except ScanError as e:
                    out["error"] = {"message": e.message, "line": e.line, "col": e.col}
                rows.append(out)
            token = pa.struct([("kind", pa.string()), ("text", pa.string()), ("line", pa.int32()), ("col", pa.int32())])
            error = pa.struct([("message", pa.string()), ("line", pa.int32()), ("col", pa.int32())])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file_id", pa.int32()), ("path", pa.string()), ("language", pa.string()), ("tokens", pa.list_(token)), ("error", error)]))

    return run


def tokenize(files: DataFrame, encoding: str = "auto") -> DataFrame:
    """Tokens of each file of (file_id, path, language, content)."""
    return files.select("file_id", "path", "language", "content").mapInArrow(_tokenize(encoding), TOKENS)


def _extract(least: int):
    schema = pa.schema(
        [("file_id", pa.int32()), ("path", pa.string()), ("language", pa.string()), ("name", pa.string())]
        + [(c, pa.int32()) for c in ("start_line", "start_col", "end_line", "end_col", "token_start", "token_end")]
        + [("struct_ids", pa.list_(pa.int64())), ("text_ids", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                language = registry.by_name(row["language"])
                if not language or row["tokens"] is None:
                    continue
                tokens = [Token(**t) for t in row["tokens"]]
                counted = [t.kind not in language.strip for t in tokens]
                before = [0]
                for c in counted:
                    before.append(before[-1] + c)
                for b in language.find_blocks(tokens, lambda i, j, before=before: before[j] - before[i], least):
                    own = [t for t, c in zip(tokens[b.start : b.end], counted[b.start : b.end], strict=True) if c]
                    first, last = tokens[b.start], tokens[b.end - 1]
                    rows.append(
                        {
                            "file_id": row["file_id"], "path": row["path"], "language": row["language"], "name": b.name, "start_line": first.line, "start_col": first.col, "end_line": last.line,
                            "end_col": last.col, "token_start": b.start, "token_end": b.end, "struct_ids": list(map(structural_id, own)), "text_ids": list(map(text_id, own)),
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def extract_blocks(tokenized: DataFrame, min_tokens: int = 30) -> DataFrame:
    """Blocks of at least ``min_tokens`` counted tokens, with ``block_id`` in the order of files and places."""
    rows = materialize(tokenized.filter("tokens is not null").mapInArrow(_extract(min_tokens), BLOCKS), "extracted")
    return attach_numbers(rows, ["file_id", "token_start"], ["file_id", "token_start"], "block_id")


def text_blocks(texts: DataFrame, id_col: str, text_col: str = "text", min_tokens: int = 30, structural: bool = False, *carried: str) -> DataFrame:
    """Blocks (block_id, struct_ids, text_ids, carried columns) of a table of texts, tokenized in the JVM."""
    from echosieve.functions import columns as C

    rows = C.settle(texts.select(F.col(id_col).alias("block_id"), F.col(text_col).alias("es_text"), *carried), es_tokens=C.prose_tokens(F.col("es_text")))
    rows = rows.filter(F.size("es_tokens") >= min_tokens)
    ids = C.token_ids(F.col("es_tokens"))
    plain = C.token_ids(C.structural_ids(F.col("es_tokens"))) if structural else ids
    rows = C.settle(rows, struct_ids=plain, text_ids=ids)
    return rows.select("block_id", "struct_ids", "text_ids", *carried)
