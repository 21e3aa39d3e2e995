"""Reports hold every group and region unless a limit is asked for."""

import json

from pyspark.sql import Row

from echosieve.cli import parser
from echosieve.plans.report import document, text, write_report


class Found:
    """Stands for a session with many groups and blocks with repeated regions."""

    def __init__(self, spark, n):
        self.spark, self.n = spark, n

    def clone_groups(self, limit=20):
        block = "array(named_struct('name', 'f', 'path', 'é.cpp', 'start_line', 1, 'start_col', 2, 'end_line', 3, 'end_col', 4))"
        return self.spark.range(self.n).selectExpr("id as group_index", "2L as size", "0.5D as avg_similarity", f"{block} as blocks").orderBy("group_index").limit(limit)

    def intra_regions(self):
        pair = "array(named_struct('a_start', 1, 'a_len', 2, 'b_start', 3, 'b_len', 4, 'similarity', 1.0D))"
        return self.spark.range(self.n).selectExpr("concat('f', id) as name", "'p' as path", "1 as start_line", f"{pair} as pairs", "id").orderBy("id")

    def summary(self):
        row = Row(files=1, blocks=2, groups=self.n, duplicated_functions=0, duplicated_lines=0, intra_functions=self.n, intra_pairs=self.n)
        return self.spark.createDataFrame([row])


def test_all_groups_and_regions(spark, tmp_path):
    found, out = Found(spark, 1500), tmp_path / "r.json"
    write_report(found, f"json:file={out}")
    d = json.loads(out.read_text(encoding="utf-8"))
    assert d == document(found) and out.read_text() == json.dumps(d, indent=2) + "\n"
    assert len(d["cloneGroups"]) == len(d["intraClones"]) == d["summary"]["totalGroups"] == 1500
    assert [g["groupIndex"] for g in d["cloneGroups"]] == list(range(1, 1501))
    assert text(found).count("Clone group #") == text(found).count("Repeated regions in ") == 1500


def test_limit_is_an_option(spark, tmp_path):
    assert parser().parse_args(["x"]).limit is None and parser().parse_args(["x", "--limit", "3"]).limit == 3
    for n, limit in ((5, 3), (0, None)):
        out = tmp_path / f"{n}.json"
        write_report(Found(spark, n), f"json:file={out}", limit)
        assert out.read_text() == json.dumps(document(Found(spark, n), limit), indent=2) + "\n"
        assert len(json.loads(out.read_text())["cloneGroups"]) == min(n, 3)
