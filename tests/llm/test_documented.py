import pytest

from conftest import FILE, SYMBOL
from factloom.llm import documented as d

PY = 'import os\n\nclass A:\n    @property\n    def size(self, unit):\n        r"""Bytes used on disk, rounded up to whole pages."""\n        return 1\n\n    def todo(self):\n        """TODO"""\n\ndef none(x):\n    return x\n\ndef multi(\n    a: int = (1),\n    b=":",\n):\n    # first\n    \'Keeps the order in which rows arrived.\'\n    return a\n'


def offset(text, line):
    return sum(len(x) + 1 for x in text.split("\n")[: line - 1])


def test_python_docs():
    assert d.python_doc(PY, offset(PY, 5))[0].startswith("Bytes used") and d.python_doc(PY, offset(PY, 4))[0].startswith("Bytes used")
    assert d.python_doc(PY, offset(PY, 9))[0] == "TODO" and d.python_doc(PY, offset(PY, 12))[0] is None
    assert d.python_doc(PY, offset(PY, 15))[0].startswith("Keeps the order") and d.python_doc("x = 1\n", 0) == (None, "")


def test_elisp_docs():
    assert d.elisp_doc('(defun f (x &optional y)\n  "Say \\"hi\\" to X."\n  (g x))', 0) == ('Say "hi" to X.', "x &optional y")
    assert d.elisp_doc("(defun f ()\n  (g))", 0)[0] is None and d.elisp_doc('(defun f nil "Doc." 1)', 0)[0] == "Doc."
    assert d.elisp_doc("(defun f", 0)[0] is None


def test_comments_above():
    lines = "int a; // no\nint f();\n\n/** One.\n *  Two.\n */\nint g();\n// A\n// B\nint h();\n/* far */\n\nint i();\n/// T\ntemplate <class X>\nint j();\n/* x */ int k;\nint l();".split("\n")
    above = lambda n: d.comment_above(lines, n)
    assert above(2) is None and above(7).split() == ["One.", "Two."] and above(10) == "A\nB" and above(13) is None and above(16) == "T" and above(18) is None and above(1) is None


@pytest.mark.parametrize(
    "doc", ["", "TODO", "tbd.", "====", "A function.", "Method read_file of this class.", "read file", "readFile()", "@param path\n@return", ":param path:\n:return:", "Reads a file.", "Implementation of read_file.", "未記入", "Noch zu dokumentieren.", "pylint: disable=all", "Copyright (c) 2020 X Y Z", "old_read(path, 3);", "---", "See code.", "Code generated by x. DO NOT EDIT.", "This is the read file method. It is used to read file."]
)
def test_says_nothing(doc):
    assert not d.says_something(doc, "read_file", "m.read_file", "path")


@pytest.mark.parametrize("doc", ["Falls back to the mirror after three tries.", "TODO\n\nNot safe to call from a signal handler.", "Gibt die älteste Zeile zurück.", "指定した行を走査して返す。", "At most 9 rows are kept.", "@param path where the archive lies on disk", "Read file.\nAn unknown owner means root."])
def test_says_something(doc):
    assert d.says_something(doc, "read_file", "m.read_file", "path")


def test_signatures():
    s = lambda line, lang="cpp": d.signature([line], 1, lang, "")[0]
    assert s("int f(const char *a, std::vector<int> &b, int c = 3);") == s("int f(char *x, std::vector<int> &y, int z) {") != s("int f(char *x) {")
    assert s("int f(void);") == s("int f() {") == "" and s("func (t *T) M(a *Item, n int) {", "go") == "*Item,int"


def test_table(spark, make):
    files = make(FILE, [{"file_id": "p", "relative_path": "a.py", "project_id": "1"}, {"file_id": "h", "relative_path": "a.h", "project_id": "1"}, {"file_id": "c", "relative_path": "a.c", "project_id": "1"}, {"file_id": "n", "relative_path": "n.py"}])
    texts = spark.createDataFrame([("p", PY.replace("\n", "\r\n"), 1), ("h", "/** Waits for the slowest worker. */\nint run(int a);\nint run(char *s);\n", 1), ("c", "int run(int n)\n{\n}\nint run(char *q)\n{\n}\n", 1), ("n", None, 1)], "file_id string, content string, code int")
    sym = lambda i, f, n, k, a, b: {"symbol_id": i, "file_id": f, "name": n, "qualified_name": n, "kind": k, "start_line": a, "end_line": b}
    rows = [sym("1", "p", "size", " Method", 5, 7), sym("1", "p", "size", " Method", 5, 7), sym("2", "p", "todo", "method", 9, 10), sym("3", "p", "multi", "FUNCTION", 15, 21), sym("4", "h", "run", "function_declaration", 2, 2), sym("5", "h", "run", "function_declaration", 3, 3)]
    rows += [sym("6", "c", "run", "function", 1, 3), sym("7", "c", "run", "function", 4, 6), sym("8", "p", "far", "function", 999, 1000), sym("9", "p", "null", "function", None, None), sym("10", "n", "x", "function", 1, 1), sym("11", None, "x", "function", 1, 1), sym(None, "p", "x", "function", 5, 7), sym("12", "p", "A", "class", 3, 10)]
    s = make(SYMBOL, rows)
    assert sorted(r.symbol_id for r in d.documented(s, files, texts).collect()) == ["1", "3"]
    got = {r.symbol_id: r for r in d.pairs(s, files, texts).collect()}
    assert set(got) == {"1", "3", "6"} and got["6"].documentation == "Waits for the slowest worker." and got["6"].doc_from == "declaration" and got["1"].code.startswith("    def size")
    assert d.documented(s.limit(0), files, texts).count() == 0 and d.documented(s, files, texts.limit(0)).count() == 0


def test_long_heads_are_read_to_their_end():
    head = lambda end: "int f(\n" + ",\n".join(f"    const int a{i} /* ) */" for i in range(15)) + ")" + end
    wide = d.signature(head(";").split("\n"), 1, "c", "")[0]
    assert wide == d.signature(head(" {").split("\n"), 1, "c", "")[0] == ",".join(["int"] * 15)
    args = " ".join(f"a{i}" for i in range(900))
    assert d.elisp_doc(f'(defun f ({args})\n  "Keeps all." 1)', 0) == ("Keeps all.", args)
    assert d.elisp_doc('(defun f (x)\n  (message "no")\n  "late")', 0)[0] is None
    many = "@d(\n  1,\n  key=':',\n)\n" * 80 + 'def f(x):\n    """Keeps all."""\n'
    assert d.python_doc(many, 0) == ("Keeps all.", "(x)")
    assert d.signature(["func (r *R) Do(a int, b *Item) error {"], 1, "go", "")[0] == "int,*Item" and d.signature(["int x;", "int g(int a);"], 1, "c", "")[0] == ""


def test_overloads_of_documented_declarations(spark, make):
    files = make(FILE, [{"file_id": "h", "relative_path": "a.h", "project_id": "1"}, {"file_id": "c", "relative_path": "a.cc", "project_id": "1"}, {"file_id": "o", "relative_path": "a.cc", "project_id": "2"}])
    decl = "/** Adds up to the last page. */\nint run(int a,\n" + "\n".join(f"  int b{i}," for i in range(12)) + "\n  int z);\n/** Falls back to a mirror. */\nint run(int a,\n" + "\n".join(f"  int b{i}," for i in range(12)) + "\n  char *z);\nint run(int a);\n"
    body = "int run(int k, " + ", ".join(f"int c{i}" for i in range(12)) + ", char *q)\n{\n}\nint run(int k)\n{\n}\nint run(int k, " + ", ".join(f"int c{i}" for i in range(12)) + ", int q)\n{\n}\n"
    texts = spark.createDataFrame([("h", decl), ("c", body), ("o", body)], "file_id string, content string")
    sym = lambda i, f, k, a, b: {"symbol_id": i, "file_id": f, "name": "run", "qualified_name": "run", "kind": k, "start_line": a, "end_line": b}
    rows = [sym("d1", "h", "function_declaration", 2, 15), sym("d2", "h", "function_declaration", 17, 30), sym("d3", "h", "function_declaration", 31, 31)]
    rows += [sym(f"{i}{f}", f, "function", a, a + 2) for f in "co" for i, a in (("x", 1), ("y", 4), ("z", 7))]
    got = {r.symbol_id: (r.documentation, r.doc_from) for r in d.pairs(make(SYMBOL, rows), files, texts).collect()}
    assert got == {"xc": ("Falls back to a mirror.", "declaration"), "zc": ("Adds up to the last page.", "declaration")}


def test_found_runs_the_join_of_declarations(spark, make):
    files = make(FILE, [{"file_id": "h", "relative_path": "a.h", "project_id": "1"}, {"file_id": "c", "relative_path": "a.c", "project_id": "1"}])
    texts = spark.createDataFrame([("h", "/** Waits for the slowest worker. */\nint run(int a);\n"), ("c", "int run(int n)\n{\n}\n/* Falls back to a mirror. */\nint own(int n)\n{\n}\n")], "file_id string, content string")
    sym = lambda i, f, n, k, a: {"symbol_id": i, "file_id": f, "name": n, "qualified_name": n, "kind": k, "start_line": a, "end_line": a + 2}
    # rows "b" and " B" are one symbol, of which one row has an own comment and the other only a documented declaration
    s = make(SYMBOL, [sym("d", "h", "run", "function_declaration", 2), sym("a", "c", "run", "function", 1), sym("b", "c", "own", "function", 5), sym(" B", "c", "run", "function", 1)])
    found = d.documented(s, files, texts)
    assert [r.symbol_id for r in found.collect()] == ["b"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.split("\n") if "Join Inner" in x)
    assert all(k in join for k in ("project_id", "qualified_name", "signature"))
    assert sorted((r.symbol_id, r.documentation, r.doc_from) for r in d.pairs(s, files, texts).collect()) == [("a", "Waits for the slowest worker.", "declaration"), ("b", "Falls back to a mirror.", "own")]
