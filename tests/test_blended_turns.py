"""Blends of consecutive turns of any length, against a dynamic program."""

import random
import re

import pytest

from echosieve.functions.similarity import blended_threshold
from echosieve.plans import queries as core


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def dice(a, b):
    return 2 * dp(a, b) / (len(a) + len(b)) if a and b else 0.0


def test_turns_of_any_length(spark, tmp_path):
    rng = random.Random(2)
    base = [rng.choice(["ab", "c", "7", "12", ".", "é"]) for _ in range(200)]
    of = lambda n, k: " ".join(w if rng.randrange(100) >= k else rng.choice(["zz", "9", "!"]) for w in base[:n])
    rows = [(1, i, of(n, k)) for i, (n, k) in enumerate([(10, 5), (62, 5), (63, 5), (64, 0), (200, 5), (190, 10), (200, 60)])]
    rows += [(2, 0, None), (2, 1, ""), (2, 2, of(100, 0)), (2, 3, of(100, 3)), (3, 0, "one")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    token = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9_]")
    kinds = lambda t: ["w" if re.match("[A-Za-z_]", x) else "n" if x[0].isdigit() else x for x in t]
    exact, compat = {}, {}
    for (c, _, x), (d, turn, y) in zip(rows, rows[1:], strict=False):
        if c == d:
            b, a = token.findall(x or ""), token.findall(y or "")
            exact[c, turn] = pytest.approx(0.7 * dice(kinds(a), kinds(b)) + 0.3 * dice(a, b), abs=1e-6)
            compat[c, turn] = pytest.approx(blended_threshold(kinds(a), kinds(b), a, b, 0.3, 0.8), abs=1e-6)
    for name, want in (("blended_similarity_exact_all", exact), ("blended_similarity_compat", compat)):
        assert {(r.conv_id, r.turn): r.similarity for r in core.QUERIES[name](spark, str(tmp_path)).collect()} == want
