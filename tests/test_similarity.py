import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echosieve.functions import columns as C
from echosieve.functions import similarity as S


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("n", [10, 63, 64, 65, 127, 128, 256, 257])
def test_lcs_at_word_edges(n):
    rng = random.Random(n)
    a, b = ([rng.randrange(20) for _ in range(m)] for m in (n, n + 3))
    assert S.lcs_length(a, b) == dp(a, b)
    assert S.lcs_dice(a, b) == pytest.approx(2 * dp(a, b) / (len(a) + len(b)), abs=1e-10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_lcs_random(a, b):
    assert S.lcs_length(a, b) == dp(a, b)
    in_a, in_b = S.lcs_alignment(a, b)
    assert sum(in_a) == sum(in_b) == dp(a, b)
    assert [x for x, m in zip(a, in_a) if m] == [y for y, m in zip(b, in_b) if m]


def _texts(n, changed):
    a = [2000 + i for i in range(n)]
    return [1000] * n, a, [900000 + i for i in range(changed)] + a[changed:]


@pytest.mark.parametrize(("n", "changed", "exact", "compat"), [(100, 28, 0.916, 0.700), (100, 20, 0.94, 0.94), (100, 21, 0.937, 0.700), (64, 13, 0.939062, 0.700), (300, 70, 0.93, 0.700)])
def test_blends(n, changed, exact, compat):
    s, a, b = _texts(n, changed)
    assert S.blended(s, s, a, b, 0.3) == pytest.approx(exact, abs=1e-6)
    assert S.blended_threshold(s, s, a, b, 0.3, 0.8) == pytest.approx(compat, abs=1e-6)


def test_blend_edges():
    assert S.lcs_dice([], [1]) == 0.0
    assert S.blended_threshold([1] * 5, [2] * 5, [7] * 5, [7] * 5, 1.0, 0.1) == 1.0
    assert S.blended_threshold([1] * 5, [2] * 5, [7] * 5, [7] * 5, 0.3, 0.8) == 0.0
    half = [i if i % 2 else -i - 1 for i in range(200)]
    assert S.lcs_dice_threshold(list(range(200)), half, 0.97) == 0.0
    assert S.blended([1], [1], [], [], 0.5) == 1.0


def test_columns(spark):
    rng = random.Random(5)
    rows = [([rng.randrange(6) for _ in range(rng.randrange(0, 62))], [rng.randrange(6) for _ in range(rng.randrange(0, 62))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    got = C.settle(df, lcs=C.lcs_short(F.col("a"), F.col("b")), same=S.lcs_dice_udf()("a", "b")).collect()
    assert [r.lcs for r in got] == [dp(a, b) for a, b in rows]
    assert [r.same for r in got] == pytest.approx([S.lcs_dice(a, b) for a, b in rows])


@pytest.mark.parametrize(("ids", "value"), [([5, 1000, 133, 1001, 95, 1000, 94, 12, 1000, 89], 1193836326403798524), ([1000] * 10, 2303639133275319580), (list(range(1, 11)), 1704132864914402704), ([227] * 10, 1306912706386153488)])
def test_poly_hash(spark, ids, value):
    df = spark.createDataFrame([(ids, ids + ids[:1])], "ids array<bigint>, more array<bigint>")
    row = df.select(C.poly_windows(F.col("ids"), 10).alias("w"), F.size(C.poly_windows(F.col("more"), 10)).alias("n"), F.size(C.poly_windows(F.slice("ids", 1, 9), 10)).alias("none")).first()
    assert row.w == [value] and row.n == 2 and row.none == 0


def test_least_shared(spark):
    lengths = spark.createDataFrame([(100, 100), (40, 40)], "a bigint, b bigint")
    for t, expected in ((0.90, [3, 3]), (0.95, [22, 7]), (0.97, [31, 10])):
        got = lengths.select("a", C.least_shared(F.col("a"), F.col("b"), 10, 3, t).alias("m")).orderBy(F.desc("a"))
        assert [r.m for r in got.collect()] == expected


def test_length_ratio(spark):
    df = spark.createDataFrame([(100, 95, 95, True), (100, 90, 95, False), (100, 80, 80, True), (100, 60, 80, False), (0, 0, 10, False)], "a int, b int, p int, e boolean")
    for p in (95, 80, 10):
        for r in df.filter(F.col("p") == p).select("e", C.length_ratio_ok(F.col("a"), F.col("b"), p).alias("g")).collect():
            assert r.e == r.g


def test_small_columns(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 9, 3, 4], "a/b.C.PY", "one\ntwo\nthree")], "a array<int>, b array<int>, p string, t string")
    r = df.select(
        C.positional_similarity(F.col("a"), F.col("b")).alias("s"), C.extension(F.col("p")).alias("e"), C.source_lines(F.col("t"), F.lit(2), F.lit(3)).alias("l"),
        C.overlap(F.lit(0), F.lit(5), F.lit(3), F.lit(9)).alias("o"), C.lines_overlap(F.lit(1), F.lit(3), F.lit(3), F.lit(5)).alias("m"),
    ).first()
    assert (r.s, r.e, r.l, r.o, r.m) == (0.75, ".py", "two\nthree", 2, True)


def test_histogram(spark):
    df = C.settle(spark.createDataFrame([([3, 1, 3, 2, 3],), ([],), ([7],)], "a array<int>"), s=F.array_sort("a"))
    assert [r.h for r in df.select(C.histogram(F.col("s")).alias("h")).collect()] == [{1: 1, 2: 1, 3: 3}, {}, {7: 1}]
