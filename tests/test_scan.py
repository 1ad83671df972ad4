"""Scanning a source tree, declarations, line histories and the text sinks."""

import pytest

from factloom import sinks
from factloom.sources import reports, scan


@pytest.mark.parametrize(
    "rule, path, hit",
    [
        ("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("/build", "build/x.py", True), ("/build", "src/build/x.py", False), ("build/", "src/build/x.py", True), ("build/", "build", False),
        ("a/**/z.py", "a/z.py", True), ("a/**/z.py", "a/b/c/z.py", True), ("doc/*.py", "doc/a.py", True), ("doc/*.py", "doc/x/a.py", False), ("**/gen", "x/gen/y.c", True), ("out/**", "out/a/b.c", True), ("f?.py", "fx.py", True), ("[ab].py", "b.py", True), ("[!ab].py", "b.py", False), ("# x", "# x", False), ("\\#x", "#x", True),
    ],
)
def test_rules(spark, rule, path, hit):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(scan.ignored(df.path, scan.ignore_rules([rule]))).first()[0] is hit


def test_taken_back(spark):
    rules = scan.ignore_rules(["*.py", "!keep.py", "gone/", "!gone/keep.py", "", "  "])
    df = spark.createDataFrame([("a.py",), ("keep.py",), ("x/keep.py",), ("gone/keep.py",)], "path string")
    assert [r[0] for r in df.select(scan.ignored(df.path, rules)).collect()] == [True, False, False, True]


def test_scan(spark, tmp_path):
    for name, body in {"src/a.py": b"x = 1\n", "src/vendor/b.py": b"", "src/skip.c": b"int x;", "src/b.c": "é".encode("latin-1"), "notes.txt": b"no", "build/z.py": b"y", ".hidden/q.go": b"package q"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r.path: (r.language, r.content) for r in scan.scan(spark, str(tmp_path), ["vendor"], ["skip.c"], ["/build/"]).collect()}
    assert got == {"src/a.py": ("python", "x = 1\n"), "src/b.c": ("c", None)} or got == {"src/a.py": ("python", "x = 1\n"), "src/b.c": ("c", None), ".hidden/q.go": ("go", "package q")}


def test_needs(spark):
    files = [("pyproject.toml", '[project]\ndependencies = ["numpy>=1", "py_spark[sql]"]\n[project.optional-dependencies]\ntest = ["pytest"]\n'), ("x/requirements-dev.txt", "# c\n-r a\nruff==1\n\n"), ("bad/pyproject.toml", "[["), ("setup.py", "x"), ("requirements.txt", None)]
    got = {tuple(r) for r in scan.declared(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {("pyproject.toml", "numpy", "dependencies"), ("pyproject.toml", "py_spark", "dependencies"), ("pyproject.toml", "pytest", "test"), ("x/requirements-dev.txt", "ruff", "requirements-dev.txt")}
    assert scan.cases("e.toml", '[[case]]\nq = "x"\nexpect = ["a.b"]\n') == [{"q": "x", "expect": ["a.b"], "path": "e.toml"}] and scan.cases("e", "=") == []


def test_histories(spark):
    text = "\x01h2\x02Ann\x022024-02-01\x02second\n\n\x01h1\x02Bo\x022024-01-01\x02first\n"
    got = reports.git_lines(spark.createDataFrame([("a.py", 1, 9, text)], "path string, start int, end int, text string")).orderBy("rank").collect()
    assert [(r.commit, r.author, r.day, r.subject) for r in got] == [("h2", "Ann", "2024-02-01", "second"), ("h1", "Bo", "2024-01-01", "first")]
    o = spark.createDataFrame([("r1", "call", "a", "b", None, 2), ("r2", "call", "a", "b", None, 1), ("r1", "io", "a", "f", None, 1)], "run_id string, kind string, subject string, object string, line int, count long")
    assert [(r.run_id, r.kind) for r in reports.observed_of(o, "r1").collect()] == [("r1", "call"), ("r1", "io")] and reports.observed_of(o, kind="call").count() == 2


def test_texts_and_imports(spark):
    schema = "tool string, source_name string, source_sha256 string, n int"
    old = spark.createDataFrame([("t", "a", "1", 0), ("t", "b", "2", 0), ("u", "a", "3", 0), ("u", "z", None, 0)], schema)
    new = spark.createDataFrame([("t", "a", "9", 1), ("v", "c", "2", 1)], schema)
    assert {tuple(r) for r in sinks.replace_imported(old, new).collect()} == {("t", "a", "9", 1), ("v", "c", "2", 1), ("u", "a", "3", 0), ("u", "z", None, 0)}
    items = spark.createDataFrame([(1, "s", "m.f", "m.py", 1, 2, 0, None)], "rank int, sid string, qname string, path string, start_line int, end_line int, distance int, parent string")
    lines = spark.createDataFrame([("s", 2, "    ```"), ("s", 1, "def f():"), ("t", 1, "no")], "sid string, line int, text string")
    text = sinks.extract_markdown(items, lines)
    assert "````\n1 | def f():\n2 |     ```\n````" in text and "| 1 | `m.f` | `m.py:1-2` | 0 |  |" in text and "no" not in text
    with pytest.raises(ValueError):
        sinks.extract_markdown(items.union(items), lines, 1)
    tree = sinks.tree_text(spark.createDataFrame([("a/b.py", "f", 3), ("a/b.py", None, None), ("a/b.py", "g", 1), ("c.py", None, None)], "path string, symbol string, start_line int"))
    assert tree == "a/\n  b.py\n    g\n    f\nc.py\n"
