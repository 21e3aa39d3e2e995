"""The queries that run the whole search, against plain Python over the smallest tables."""

import re
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from test_detect import expected_regions

from echosieve.config import IntraConfig
from echosieve.plans import queries as core

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tokens(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    cut = {r.doc_id: re.findall(core._RE, r.text or "") for r in rows}
    return {i: t for i, t in cut.items() if len(t) >= 30}


def common_length(a, b):
    """Longest common subsequence by the table's rows."""
    number = {x: k for k, x in enumerate({*a, *b})}
    b = np.array([number[x] for x in b])
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == number[x])))
    return int(row[-1])


@pytest.fixture(scope="module")
def similar(tokens):
    """(a, b) -> similarity of the pairs with three windows in common and a similarity of 0.8."""
    holders = defaultdict(list)
    for i, t in tokens.items():
        for w in {tuple(t[k : k + 10]) for k in range(len(t) - 9)}:
            holders[w].append(i)
    most = max(50, len(tokens) // 2)
    shared = Counter(p for at in holders.values() if 2 <= len(at) <= most for p in combinations(sorted(at), 2))
    out = {}
    for (a, b), n in shared.items():
        x, y = tokens[a], tokens[b]
        if n >= 3 and 2 * min(len(x), len(y)) / (len(x) + len(y)) >= 0.8:
            s = 1.0 if x == y else 2.0 * common_length(x, y) / (len(x) + len(y))
            if s >= 0.8:
                out[a, b] = s
    return out


def test_pairs(spark, similar):
    got = {(r.a, r.b): r.similarity for r in core.QUERIES["lcs_dice_documents"](spark, str(SF)).collect()}
    assert got == pytest.approx(similar, abs=1e-6) and len(got) > 10 and min(got.values()) < 1


def test_groups(spark, similar):
    group = {i: i for p in similar for i in p}
    changed = True
    while changed:
        changed = False
        for p in similar:
            least = min(group[i] for i in p)
            changed |= any(group[i] != least for i in p)
            group.update(dict.fromkeys(p, least))
    size, parts = Counter(group.values()), defaultdict(list)
    for (a, _), s in similar.items():
        parts[group[a]].append(s)
    want = {i: (g, size[g], pytest.approx(sum(parts[g]) / len(parts[g]), abs=1e-6)) for i, g in group.items()}
    assert {r.doc_id: (r.group_id, r.size, r.avg_similarity) for r in core.QUERIES["clone_detection"](spark, str(SF)).collect()} == want


def test_repeated_regions(spark, tokens):
    got = defaultdict(list)
    for r in core.QUERIES["intra_regions"](spark, str(SF)).collect():
        got[r.doc_id].append((r.a_start, r.a_len, r.b_start, r.b_len, r.similarity))
    want = {i: p for i, t in tokens.items() if (p := expected_regions(t, None, IntraConfig()))}
    assert want and got == want
