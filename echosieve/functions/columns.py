"""Column functions on token sequences. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, numbers and single other characters; the white space is listed, since engines differ in what \s holds.
PROSE = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9_]"
#: 2**61 - 1, the modulus of the polynomial window hash.
PRIME = (1 << 61) - 1


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, whatever uses them.

    A plain projection may be merged into the lambdas that refer to it and then
    be computed for every element; a generator is not merged.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def prose_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PROSE), F.lit(0))


def token_ids(tokens: Column) -> Column:
    """64-bit ids of token texts."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def structural_ids(tokens: Column) -> Column:
    """Ids that tell words, numbers and other characters apart, and the latter by what they are."""
    return F.transform(tokens, lambda t: F.when(t.rlike("^[A-Za-z_]"), F.lit("w")).when(t.rlike("^[0-9]"), F.lit("n")).otherwise(t))


def window_hashes(ids: Column, size: int) -> Column:
    """Hash of every run of ``size`` ids; none for shorter arrays. ``ids`` should be a settled column."""
    n = F.size(ids)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(ids, i, size)))).otherwise(F.array().cast("array<bigint>"))


def poly_hash(ids: Column) -> Column:
    """Polynomial hash with base 257 modulo 2**61 - 1.

    257 h = 256 h + h, and 256 h is a rotation by 8 of the 61 bits, so nothing
    overflows a BIGINT.
    """
    low = (1 << 53) - 1

    def step(h: Column, t: Column) -> Column:
        turned = F.shiftleft(h.bitwiseAND(F.lit(low)), 8).bitwiseOR(F.shiftright(h, 53))
        return ((turned + h) % F.lit(PRIME) + t) % F.lit(PRIME)

    return F.aggregate(ids, F.lit(0).cast("bigint"), step)


def poly_windows(ids: Column, size: int) -> Column:
    """Polynomial hash of every run of ``size`` ids."""
    n = F.size(ids)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: poly_hash(F.slice(ids, i, size)))).otherwise(F.array().cast("array<bigint>"))


def histogram(ordered: Column) -> Column:
    """Map from each id to its count, from a settled column of sorted ids: the lengths of its runs."""
    n = F.size(ordered)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))))
    ends = F.concat(F.slice(starts, F.lit(2), n), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<int>")))
    return F.map_from_entries(F.zip_with(starts, ends, lambda i, j: F.struct(F.get(ordered, i), j - i)))


def length_ratio_ok(a: Column, b: Column, percent: int) -> Column:
    """Whether 2 min / (a + b) reaches the threshold; never for empty sequences."""
    return (a > 0) & (b > 0) & (200 * F.least(a, b) >= percent * (a + b))


def least_shared(a: Column, b: Column, window: int, floor: int, threshold: float) -> Column:
    """Least number of shared windows for lengths a and b: half of what a share of unbroken windows would leave, ``floor`` at least."""
    survive = max(0.0, 1.0 - (1.0 - threshold) * window)
    if survive <= 0:
        return F.lit(floor).cast("bigint")
    count = lambda n: F.when(n > window, n - window + 1).otherwise(0)
    return F.greatest(F.lit(floor).cast("bigint"), F.floor(F.lit(survive * 0.5) * F.least(count(a), count(b))).cast("bigint"))


def lcs_short(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by bit rows; ``b`` holds at most 62 ids. Both should be settled columns."""
    one = F.lit(1).cast("bigint")

    def places(x: Column) -> Column:
        return F.aggregate(F.transform(b, lambda y, j: F.when(y == x, F.call_function("shiftleft", one, j)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda m, bit: m.bitwiseOR(bit))

    def row(m: Column, p: Column) -> Column:
        x = m.bitwiseOR(p)
        return x.bitwiseAND((x - F.shiftleft(m, 1).bitwiseOR(one)).bitwiseXOR(x))

    return F.bit_count(F.aggregate(F.transform(a, places), F.lit(0).cast("bigint"), row))


def dice(common: Column, a: Column, b: Column) -> Column:
    """2 common / (a + b); 0 if a sequence is empty."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(2.0 * common / (a + b))


def blended(structural: Column, textual: Column, weight: float) -> Column:
    """The plain blend of both similarities."""
    return structural if weight <= 0 else (1.0 - weight) * structural + weight * textual


def overlap(start1: Column, length1: Column, start2: Column, length2: Column) -> Column:
    """Common length of two intervals."""
    return F.greatest(F.lit(0), F.least(start1 + length1, start2 + length2) - F.greatest(start1, start2))


def lines_overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Whether two inclusive line ranges meet."""
    return (start1 <= end2) & (end1 >= start2)


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two arrays of one length; 1 for empty ones."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(equal / F.size(a))


def source_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1) of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def glob_match(name: Column, patterns: list[str]) -> Column:
    """Whether a file name matches any glob; * and ? only, case-sensitive."""
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(glob_regex(p))
    return out


def glob_regex(pattern: str) -> str:
    import re

    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + r"\z"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
