import json
import subprocess
from pathlib import Path

import pytest

from echosieve.cli import main, parser
from echosieve.config import AnalysisConfig, Scope
from echosieve.plans.report import document, duration, parse_spec, text
from echosieve.plans.session import Session


def body(name, n, t):
    return f"int {name}(int {n}) {{ int {t} = 0; for (int i = 0; i < {n}; ++i) {{ if (i % 2 == 0) {{ {t} += i * 3; }} else {{ {t} -= i; }} }} return {t}; }}\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    d = tmp_path_factory.mktemp("tree").resolve()
    run = lambda *a: subprocess.run(["git", "-C", str(d), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (d / "a.cpp").write_text(body("sum", "n", "t") + body("other", "count", "acc"))
    (d / "c.py").write_text("def f(x):\n    y = 0\n" + "".join(f"    y = y + x * {i} - 3\n" for i in range(8)))
    run("add", ".")
    run("commit", "-q", "-m", "one")
    run("checkout", "-q", "-b", "work")
    (d / "b.cpp").write_text("// new\n" + body("sum2", "n", "t"))
    run("add", ".")
    run("commit", "-q", "-m", "two")
    return d


@pytest.fixture(scope="module")
def session(spark, tree):
    return Session(spark, AnalysisConfig(root=str(tree), text_weight=0.0))


def test_groups(session):
    rows = session.clone_groups().collect()
    assert [(r.group_index, r.size, [b.name for b in r.blocks]) for r in rows] == [(0, 3, ["sum", "other", "sum2"])]
    assert session.clone_groups(offset=1).count() == 0
    assert session.clone_groups(path_part="c.py").count() == 0
    assert session.file_duplicates("b.cpp").count() == 1


def test_summary_and_source(session):
    s = session.summary().first()
    assert (s.files, s.blocks, s.groups, s.duplicated_functions, s.duplicated_lines, s.intra_functions) == (3, 4, 1, 3, 3, 1)
    assert "sum(int n)" in session.code_block(0).first().source
    assert session.errors().count() == 0


def test_files_and_branches(session, tree):
    assert {r.category for r in session.analyze_file(str(tree / "a.cpp")).collect()} == {"within", "cross"}
    assert [r.category for r in session.branch_duplicates("main").collect()] == ["existing"]
    with pytest.raises(FileNotFoundError):
        session.analyze_file("none")


def test_reports(session):
    d = document(session)
    assert d["cloneGroups"][0]["groupIndex"] == 1 and d["cloneGroups"][0]["blockCount"] == 3 and d["summary"]["totalFiles"] == 3
    assert json.loads(json.dumps(d)) == d
    assert "Clone group #1 (3 blocks, 100% similar)" in text(session)
    assert parse_spec("json:file=x") == ("json", "x") and parse_spec("console") == ("console", None)
    for bad in ("xml", "json:out=x", "console:file=x"):
        with pytest.raises(ValueError):
            parse_spec(bad)
    assert [duration(x) for x in (5e-5, 0.0123, 2.5)] == ["50us", "12.3ms", "2.5s"]


def test_reconfigure_and_diff(spark, tree):
    s = Session(spark, AnalysisConfig(root=str(tree), text_weight=0.0, scope=Scope.INTRA_FILE))
    assert [b.name for b in s.clone_groups().first().blocks] == ["sum", "other"]
    s.reconfigure(scope=Scope.INTER_FUNCTION, text_weight=0.3, threshold=0.95)
    assert [b.name for b in s.clone_groups().first().blocks] == ["sum", "sum2"]
    assert s.intra_regions().count() == 0
    assert s.restrict_to_diff("main") and s.clone_groups().count() == 1
    assert not s.restrict_to_diff("work")


def test_command_line(spark, tree, tmp_path):
    out = tmp_path / "r.json"
    assert main([str(tree), "--text-sensitivity", "0", "--report", f"json:file={out}", "--glob", "a.cpp"]) == 1
    assert json.loads(out.read_text())["summary"]["totalBlocks"] == 2
    assert main([str(tree / "none")]) == 2
    assert main([str(tree), "--threshold", "2"]) == 2
    assert parser().parse_args(["x"]).text_sensitivity == 0.3
    o = parser().parse_args(["x", "-t", "0.9", "-m", "12", "-s", "all", "-g", "*.cpp", "--reporter", "json", "--no-gitignore", "--no-source", "-v"])
    assert (o.threshold, o.min_tokens, o.glob, o.report, o.no_ignore, o.show_source, o.verbose) == (0.9, 12, ["*.cpp"], ["json"], True, False, True)
    assert main(["--version"]) == 0


def test_sources_come_with_the_groups(session):
    shown = text(session, source=True)
    assert shown.count("int sum(int n)") == 1 and shown.count("int sum2(int n)") == 1
    assert set(document(session)["summary"]["timing"]) == {"scanning", "tokenizing", "normalizing", "cloneDetection", "intraDetection", "total"}


def test_closing_leaves_no_tables(spark, tree):
    from echosieve.storage import shared_dir

    listed = lambda: set(Path(shared_dir(spark)).glob("echosieve-*"))
    before = listed()
    with Session(spark, AnalysisConfig(root=str(tree), text_weight=0.0)) as s:
        assert s.clone_groups().count() == 1 and listed() > before
        s.reconfigure(threshold=0.9)
    assert listed() == before
