import subprocess

import pytest
from pyspark.sql import functions as F

from echosieve.functions import columns as C
from echosieve.operators.blocks import extract_blocks, tokenize
from echosieve.sources.diff import diff_lines, git_diff, parse_diff
from echosieve.sources.encoding import detect_encoding, detect_encoding_col, parse_encoding, to_utf8, to_utf8_col
from echosieve.sources.files import glob_matches, non_ignored_files, scan_files


@pytest.mark.parametrize(
    ("pattern", "name", "expected"),
    [("*", "", True), ("*.cpp", "a.cpp", True), ("*.cpp", "a.CPP", False), ("a?c", "abc", True), ("a?c", "ac", False), ("*a*b", "xaxxb", True), ("a.c", "abc", False), ("[a]", "[a]", True), ("", "a", False), ("**x", "x", True)],
)
def test_globs(spark, pattern, name, expected):
    assert glob_matches(pattern, name) is expected
    assert spark.createDataFrame([(name,)], "n string").select(C.glob_match(F.col("n"), [pattern]).alias("g")).first().g is expected


def test_encodings(spark):
    every = bytes(range(0x80, 0x100))
    text = to_utf8(every, "windows-1252").decode()
    assert len(text) == 128 and text.count("�") == 5 and text[0] == "€" and text[-1] == "ÿ"
    cases = [b"", b"abc", "é".encode(), b"\xef\xbb\xbfabc", b"\xe9", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80"]
    kinds = ["utf-8"] * 4 + ["windows-1252"] * 4
    assert [detect_encoding(c) for c in cases] == kinds
    assert to_utf8(b"\xef\xbb\xbfabc") == b"abc" and to_utf8(b"\xe9") == "é".encode() and to_utf8(b"\xe9", "utf-8") == b"\xe9"
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, raw binary")
    got = df.select("i", detect_encoding_col(F.col("raw")).alias("k"), to_utf8_col(F.col("raw")).alias("u")).orderBy("i").collect()
    assert [r.k for r in got] == kinds and [bytes(r.u) for r in got] == [to_utf8(c) for c in cases]
    assert parse_encoding("CP1252") == "windows-1252" and parse_encoding("Auto") == "auto"
    with pytest.raises(ValueError):
        parse_encoding("latin9")


def test_scan(spark, tmp_path):
    for name in ("b.cpp", "sub/a.H", "c.py", "d.txt", "e"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\n")
    names = lambda df: [r.path.removeprefix(f"{tmp_path}/") for r in df.orderBy("file_id").collect()]
    assert names(scan_files(spark, str(tmp_path))) == ["b.cpp", "c.py", "sub/a.H"]
    assert names(scan_files(spark, str(tmp_path), [])) == ["b.cpp", "c.py", "d.txt", "e", "sub/a.H"]
    assert names(scan_files(spark, str(tmp_path), [".py"], ["*.txt", "e"])) == ["d.txt", "e"]
    assert {r.path[-1]: r.language for r in scan_files(spark, str(tmp_path), []).collect()} == {"p": "C++", "H": "C++", "y": "Python", "t": "prose", "e": None}
    with pytest.raises(NotADirectoryError):
        scan_files(spark, str(tmp_path / "none"))


def test_ignored_files(spark, tmp_path):
    assert non_ignored_files(str(tmp_path)) is None
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("out/\n")
    for name in ("a.py", "out/b.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    assert [r.path for r in scan_files(spark, str(tmp_path), respect_ignore=True).collect()] == [str(tmp_path.resolve() / "a.py")]


DIFF = """diff --git a/old.cpp b/new b/x.cpp
--- a/old.cpp
+++ b/new b/x.cpp
@@ -1,2 +10,5 @@ int f()
+a
@@ -3 +6 @@
@@ -3,1 +9,0 @@
@@ bad @@
diff --git a/gone.cpp b/gone.cpp
+++ /dev/null
@@ -1,2 +1,2 @@
diff --git a/bin.cpp b/bin.cpp
Binary files a/bin.cpp and b/bin.cpp differ
@@ -1 +1 @@
diff --git a/b.py b/b.py
@@ -0,0 +1,3 @@
"""


def test_an_over_long_line_number_is_malformed(spark):
    lines = diff_lines(spark, "diff --git a/x.cpp b/x.cpp\n+++ b/x.cpp\n@@ -1 +99999999999,2 @@\n@@ -1 +4,99999999999 @@\n@@ -1 +7,2 @@\n")
    assert [(r.start_line, r.end_line) for r in parse_diff(lines).collect()] == [(7, 8)]


def test_parse_diff(spark):
    lines = diff_lines(spark, DIFF)
    ranges = lambda *e: [(r.path, r.start_line, r.end_line) for r in parse_diff(lines, *e).orderBy("pos").collect()]
    assert ranges() == [("x.cpp", 10, 14), ("x.cpp", 6, 6), ("b.py", 1, 3)]
    assert ranges([".CPP"]) == [("x.cpp", 10, 14), ("x.cpp", 6, 6)]
    assert parse_diff(diff_lines(spark, "")).count() == 0


def test_git_diff_errors(tmp_path):
    with pytest.raises(RuntimeError):
        git_diff(str(tmp_path), "main")


def test_tokens_and_blocks(spark):
    code = "int f(int a) {{ int {0} = a; {0} += 1; return {0}; }}\n"
    files = spark.createDataFrame([(0, "a.cpp", "C++", bytearray(code.format("x") .encode())), (1, "b.cpp", "C++", bytearray(code.format("y").encode())), (2, "c.cpp", "C++", bytearray(b'"')), (3, "d", None, bytearray(b"x"))], "file_id int, path string, language string, content binary")
    tokens = tokenize(files)
    bad = {r.file_id: r.error for r in tokens.collect()}
    assert bad[0] is None and bad[2].line == 1 and "string" in bad[2].message
    found = extract_blocks(tokens, 10).orderBy("block_id").collect()
    assert [(r.block_id, r.file_id, r.name, r.start_line, r.start_col) for r in found] == [(0, 0, "f", 1, 14), (1, 1, "f", 1, 14)]
    assert found[0].struct_ids == found[1].struct_ids and found[0].text_ids != found[1].text_ids and len(found[0].text_ids) == len(found[0].struct_ids)
