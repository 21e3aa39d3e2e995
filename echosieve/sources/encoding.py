"""Encodings of source files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BOM = b"\xef\xbb\xbf"
#: Code points of Windows-1252 bytes 0x80 to 0x9F; the five undefined ones become U+FFFD.
_HIGH = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
_NAMES = {"auto": "auto", "utf8": "utf-8", "utf-8": "utf-8", "windows-1252": "windows-1252", "windows1252": "windows-1252", "cp1252": "windows-1252"}


def parse_encoding(name: str) -> str:
    """``auto``, ``utf-8`` or ``windows-1252``, from any of their names."""
    try:
        return _NAMES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown encoding: {name}") from None


def detect_encoding(raw: bytes) -> str:
    """UTF-8 if it has its mark or is valid as such, else Windows-1252."""
    if raw.startswith(_BOM):
        return "utf-8"
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "windows-1252"


def to_utf8(raw: bytes, encoding: str = "auto") -> bytes:
    """UTF-8 without a mark; bytes said to be UTF-8 are passed on as they are."""
    kind = detect_encoding(raw) if encoding == "auto" else encoding
    if kind == "utf-8":
        return raw.removeprefix(_BOM)
    return raw.decode("latin-1").translate({0x80 + i: c for i, c in enumerate(_HIGH)}).encode("utf-8")


def detect_encoding_col(raw: Column) -> Column:
    """As ``detect_encoding``, inside the JVM."""
    return F.when(F.is_valid_utf8(raw.cast("string")), F.lit("utf-8")).otherwise(F.lit("windows-1252"))


def to_utf8_col(raw: Column, encoding: str = "auto") -> Column:
    @F.pandas_udf("binary")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda x: None if x is None else to_utf8(bytes(x), encoding))

    return run(raw)
