import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from echosieve.plans import queries as core

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows):
    value = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, con, name):
    got = core.QUERIES[name](spark, str(SF))
    want = con.sql(core.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.select(*sorted(got.columns)).collect()) == canonical(want.select(*(f'"{c}"' for c in sorted(want.columns))).fetchall())


def test_similar_documents(spark):
    bags = {(r.a, r.b) for r in core.QUERIES["bag_dice_pairs"](spark, str(SF)).collect()}
    pairs = {(r.a, r.b): r.similarity for r in core.QUERIES["lcs_dice_documents"](spark, str(SF)).collect()}
    assert pairs and set(pairs) <= bags and all(0.8 <= s <= 1 for s in pairs.values())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
