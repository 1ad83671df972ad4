import json

from pyspark.sql import functions as F

from conftest import FILE
from factloom.operators import resolve
from factloom.sources import brace_source, code, python_source, reports, tables

SOURCE = '''import os
from .util import helper as h
class A(Base):
    """Doc of A.

    more"""
    @cached
    def m(self, x=[]):
        try:
            y = h(x) if x and y else os.getenv("HOME")
        except:
            pass
        return self.n(y)
    async def n(self, z):  # TODO later
        for i in z:
            yield i
'''


def test_python_facts():
    f = python_source.extract(SOURCE, "pkg/mod.py")
    assert [(s["kind"], s["qname"]) for s in f.symbols] == [("module", "pkg.mod"), ("class", "pkg.mod.A"), ("method", "pkg.mod.A.m"), ("method", "pkg.mod.A.n")]
    assert f.symbols[1]["summary"] == "Doc of A." and f.symbols[3]["is_async"] and f.symbols[3]["is_generator"] and f.symbols[2]["decorators"] == ["cached"]
    calls = {(r["source"], r["target"]) for r in f.refs if r["kind"] == "call"}
    assert {("pkg.mod.A.m", "pkg.util.helper"), ("pkg.mod.A.m", "os.getenv"), ("pkg.mod.A.m", "pkg.mod.A.n")} <= calls
    assert [(d["target"], d["is_candidate"]) for d in f.deps] == [("os", False), ("pkg.util", False), ("pkg.util.helper", True)]
    m = f.flows[0]
    assert (m["cyclomatic"], m["try_blocks"], m["swallowed"], m["returns"]) == (4, 1, 1, 1)
    assert {x["rule"] for x in f.findings} == {"mutable-default", "bare-except", "swallowed-exception", "env-read", "todo-marker", "boundary-cache"}
    assert {(v["name"], v["to"]) for v in f.variables if v["how"] == "derive"} >= {("x", "y")}


def test_python_failure_and_empty():
    assert python_source.extract("def f(:", "a.py").error and not python_source.extract("def f(:", "a.py").symbols
    assert len(python_source.extract("", "a.py").symbols) == 1


def test_other_languages():
    cpp = brace_source.extract("#include <a.h>\nclass C {\npublic:\n  int f(int a) { if (a && g(a)) return 2; return 0; }\n};\nint top()\n{\n  return foo(\"(\");\n}\nint decl(int);\n", "x.cpp", "cpp")
    assert [(s["kind"], s["qname"], s["start_line"], s["end_line"]) for s in cpp["symbols"]] == [("class", "C", 2, 5), ("method", "C::f", 4, 4), ("function", "top", 6, 9), ("function_declaration", "decl", 10, 10)]
    assert cpp["deps"][0]["target"] == "a.h" and cpp["flows"][0]["cyclomatic"] == 3
    go = brace_source.extract('package p\nimport "fmt"\nfunc (t *T) M() { fmt.Println("{") }\n', "x.go", "go")
    assert go["symbols"][0]["qname"] == "T.M" and [r["target"] for r in go["refs"]] == ["fmt.Println"] and go["deps"][0]["target"] == "fmt"
    el = brace_source.extract(";; c\n(require 'seq)\n(defun f (x) \"doc (\" (g x ?\\())\n", "x.el", "elisp")
    assert el["symbols"][0]["name"] == "f" and [r["target"] for r in el["refs"]] == ["g"] and el["deps"][0]["target"] == "seq"


def test_latest_file_and_paths(make, spark):
    t = "2024-01-0{} 00:00:00"
    rows = [("f", t.format(1), "a\\b.PY", "pending"), ("f", None, "old.c", "failed"), ("f", t.format(2), ".//src//x.py", "analyzed"), (None, t.format(3), "n.py", "x")]
    df = make(FILE.replace("timestamp_ntz", "string"), [{"file_id": a, "last_analyzed_at": b, "relative_path": c, "analysis_status": d} for a, b, c, d in rows])
    got = tables.latest_files(df).collect()
    assert [(r.path, r.stated, r.analysis_status) for r in got] == [("src/x.py", "python", "analyzed")]


def test_facts_of(make, spark):
    files = make(FILE, [{"file_id": "a", "relative_path": "p/mod.py"}, {"file_id": "b", "relative_path": "x.c"}, {"file_id": "n", "relative_path": "n.py"}, {"file_id": "t", "relative_path": "t.txt"}])
    texts = spark.createDataFrame([("a", SOURCE), ("b", "int f(void) { return g(); }\n"), ("n", None), ("t", "x")], "file_id string, content string")
    assert {r.qname for r in code.facts_of(files, texts, "symbols").collect()} == {"p.mod", "p.mod.A", "p.mod.A.m", "p.mod.A.n", "f"}
    assert code.facts_of(files, texts.limit(0), "flows").count() == 0


def test_resolution(spark):
    symbols = spark.createDataFrame(
        [("1", "a.f", "f", "function", []), ("2", "b.g", "g", "function", ["cached"]), ("3", "c.g", "g", "function", []), ("4", "d.K.m", "m", "method", []), ("5", "h", "h", "function_declaration", []), ("6", "h", "h", "function", [])],
        "sid string, qname string, name string, kind string, decorators array<string>",
    )
    refs = spark.createDataFrame([("f", "s", k, t, 1, n) for k, t, n in [("call", "a.f", ""), ("call", "b.g", ""), ("inheritance", "b.g", ""), ("call", "K.m", ""), ("call", "g", ""), ("call", "a.zz", ""), ("call", "os.path", ""), ("call", "", ""), ("call", "h", "")]], "file_id string, source string, kind string, target string, line int, note string")
    got = {(r.kind, r.target): (r.target_id, r.status, r.confidence) for r in resolve.resolve_references(refs, symbols).collect()}
    assert got["call", "a.f"] == ("1", "resolved", "confirmed") and got["call", "b.g"] == ("2", "resolved", "inferred") and got["inheritance", "b.g"] == ("2", "resolved", "confirmed")
    assert got["call", "K.m"] == ("4", "resolved", "inferred") and got["call", "g"] == (None, "ambiguous", "inferred")
    assert got["call", "a.zz"][1] == "unresolved" and got["call", "os.path"][1] == "external" and got["call", ""][1] == "unresolved" and got["call", "h"][0] == "6"


def test_dependencies(spark):
    files = spark.createDataFrame([("1", "p/a.py"), ("2", "q/a.py"), ("3", "p/b/__init__.py"), ("4", "inc/x.h")], "file_id string, path string")
    deps = spark.createDataFrame([("1", k, t, 1, c) for k, t, c in [("import", "p.a", False), ("import", "a", False), ("import", "p.b", False), ("import", "p.zz", False), ("import", "json", False), ("include", "x.h", False), ("include", "stdio.h", False), ("import", "p.a.f", True)]], "file_id string, kind string, target string, line int, is_candidate boolean")
    got = {r.target: (r.target_file_id, r.status) for r in resolve.resolve_dependencies(deps, files).collect()}
    assert got == {"p.a": ("1", "resolved"), "a": (None, "ambiguous"), "p.b": ("3", "resolved"), "p.zz": (None, "unresolved"), "json": (None, "external"), "x.h": ("4", "resolved"), "stdio.h": (None, "external")}


def test_changed_is_null_safe(spark):
    old = spark.createDataFrame([("1", None), ("2", "a"), ("3", "b")], "k string, v string")
    new = spark.createDataFrame([("1", None), ("2", None), ("3", "b"), ("4", "n")], "k string, v string")
    assert sorted(r.k for r in resolve.changed(old, new, "k", ["v"]).collect()) == ["2", "4"]


def test_sarif(spark):
    loc = lambda u, a=None: [{"physicalLocation": {"artifactLocation": {"uri": u}, "region": {"startLine": a}}}]
    results = [{"ruleId": "r1", "level": "Error", "message": {"text": "a\n  b"}, "locations": loc("file://src/x.c", 3)}, {"ruleId": "r2", "message": {"text": "m" * 600}, "locations": loc("y.c")}, {"ruleId": "r3"}, {"ruleId": "r4", "locations": loc("../etc/passwd", 1)}, {"ruleId": "r5", "locations": loc("/abs", 1)}]
    df = spark.createDataFrame([(json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t"}}, "results": results}]}),), ("broken",), (None,)], "json string")
    got = {r.rule: r for r in reports.sarif(df).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].message == "a b" and got["r1"].level == "error" and got["r2"].level == "warning" and len(got["r2"].message) == 500
    assert [r.rule for r in reports.at_least(reports.sarif(df), "error").collect()] == ["r1"]


def test_r2_and_names(spark):
    calls = spark.createDataFrame([(json.dumps([{"name": "f", "imports": ["g", "g", None]}]),)], "json string")
    assert [tuple(r) for r in reports.r2_calls(calls).collect()] == [("f", "g")]
    df = spark.createDataFrame([("sym._main(int)",)], "n string").select(reports.binary_names(F.col("n")).alias("x"))
    assert df.first().x == ["_main", "main"]


def _msg(*parts):
    out = b""
    for n, v in parts:
        out += bytes([n << 3 | (0 if isinstance(v, int) else 2)]) + (bytes([v]) if isinstance(v, int) else bytes([len(v)]) + v)
    return out


def test_scip(spark):
    occ = _msg((1, bytes([4, 2, 9])), (2, b"py pkg a/b#m()."), (3, 1))
    data = _msg((2, _msg((1, b"a.py"), (2, occ))))
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b"\xff\xff"),), (None,)], "content binary")
    assert [tuple(r) for r in reports.scip(df).collect()] == [("a.py", 4, 2, 4, "py pkg a/b#m().", True, "m")]


def test_observations_and_matching(spark):
    obs = {"functions": [{"file": "p/m.py", "qualname": "A.<locals>.f", "line": 5, "count": 2}], "calls": [{"caller": "a", "callee": "b", "count": 3}], "lines": {"p/m.py": [1, 2]}, "raised": [], "io": []}
    df = spark.createDataFrame([("r", json.dumps(obs))], "run_id string, json string")
    assert {(r.kind, r.subject, r.line) for r in reports.observations(df).collect()} == {("call", "a", None), ("function", "A.<locals>.f", 5), ("coverage", "p/m.py", 1), ("coverage", "p/m.py", 2)}
    symbols = spark.createDataFrame([("1", "p/m.py", "p.m.A.f", 5), ("2", "p/m.py", "p.m.B.A.f", 50), ("3", "q.py", "q.A.f", 5)], "sid string, path string, qname string, start_line int")
    seen = spark.createDataFrame([("p/m.py", "A.<locals>.f", 5), ("p/m.py", "zz", 1)], "path string, qualname string, line int")
    assert {r.qualname: r.sid for r in reports.match_observed(seen, symbols).collect()} == {"A.<locals>.f": "1", "zz": None}


def test_gcov_and_git(spark):
    lines = spark.createDataFrame([("x.c", "        5:    3:  a();"), ("x.c", "    #####:    4:  b();"), ("x.c", "        -:    0:Source:x.c")], "source string, value string")
    assert {tuple(r) for r in reports.gcov(lines).collect()} == {("x.c", 3, 5), ("x.c", 4, 0)}
    log = spark.createDataFrame([("\x01h1\x02Ann\x022024-01-01\n\na.py\nb.py\n\x01h2\x02Bo\x022024-01-02\n\na.py\n",)], "text string")
    assert {tuple(r) for r in reports.git_log(log).collect()} == {("h1", "Ann", "2024-01-01", "a.py"), ("h1", "Ann", "2024-01-01", "b.py"), ("h2", "Bo", "2024-01-02", "a.py")}

FLOW = '''import m
COUNT = 0
class A:
    def put(self, row, n=1):
        self.rows.append(row)
        self.size = n
        return self.size
    def many(self, rows):
        for r in rows:
            if not r:
                continue
            self.put(r, 2)
        return None
def low(x):
    raise KeyError(x)
def mid(y):
    z = y
    try:
        low(z)
    except ValueError:
        raise RuntimeError("no")
def safe(w):
    try:
        mid(w)
    except (KeyError, RuntimeError):
        pass
def bump():
    global COUNT
    COUNT = COUNT + 1
'''


def test_states_blocks_and_exceptions():
    f = python_source.extract(FLOW, "m.py")
    assert {(s["qname"], s["name"], s["access"]) for s in f.states} >= {("m.A.put", "rows", "mutate"), ("m.A.put", "size", "write"), ("m.A.put", "size", "read"), ("m.bump", "COUNT", "write"), ("m.bump", "COUNT", "read")}
    edges = {(b["block"], b["to"], b["label"]) for b in f.blocks if b["qname"] == "m.A.many"}
    assert {x[2] for x in edges} >= {"loop", "end", "back", "true", "false", "continue", "return"} and not any(x[1] == -2 for x in edges)
    assert {(e["qname"], e["what"], e["name"], e["caught"]) for e in f.exceptions} >= {("m.low", "raise", "KeyError", False), ("m.mid", "guard", "ValueError", True), ("m.mid", "raise", "RuntimeError", False)}


def test_exception_flow_and_traces(spark):
    from factloom.operators import functions

    f = python_source.extract(FLOW, "m.py")
    exc = spark.createDataFrame([tuple(e[k] for k in ("qname", "what", "name", "line", "end_line", "caught")) for e in f.exceptions], "qname string, what string, name string, line int, end_line int, caught boolean")
    calls = spark.createDataFrame([(r["source"], r["target"], r["line"]) for r in f.refs if r["kind"] == "call"], "source string, target string, line int")
    got = {(r.qname, r.exception, r.origin, r.distance) for r in functions.exception_flow(exc, calls).collect()}
    assert got == {("m.low", "KeyError", "m.low", 0), ("m.mid", "RuntimeError", "m.mid", 0), ("m.mid", "KeyError", "m.low", 1)}
    v = spark.createDataFrame([tuple(x[k] for k in ("qname", "what", "name", "how", "line", "to")) for x in f.variables], "qname string, what string, name string, how string, line int, to string")
    seeds = spark.createDataFrame([("m.safe:w",)], "node string")
    assert {tuple(r) for r in functions.trace(v, seeds, 5).collect()} == {("m.safe:w", 0), ("m.mid:y", 1), ("m.mid:z", 2), ("m.low:x", 3)}
    back = {r.node for r in functions.trace(v, spark.createDataFrame([("m.A.put:row",)], "node string"), 3, True).collect()}
    assert back == {"m.A.put:row", "m.A.many:r", "m.A.many:rows"}


def test_fields_macros_and_risks():
    c = brace_source.extract("#define N(x) ((x) + 1)\n#define M 2\nint f(struct s *p)\n{\n  p->a = p->b + q.c;\n  p->n++;\n  if (p->d == 1) strcpy(x, y);\n  return g(p->e());\n}\n", "x.c", "c")
    assert {(x["name"], x["access"]) for x in c["fields"]} == {("a", "write"), ("b", "read"), ("c", "read"), ("n", "write"), ("d", "read")}
    assert [(m["name"], m["has_parameters"], m["body"]) for m in c["macros"]] == [("N", True, "((x) + 1)"), ("M", False, "2")]
    assert [(x["rule"], x["detail"]) for x in c["findings"]] == [("unsafe-libc", "strcpy")]


def test_org_blocks():
    org = "* Title (\n#+begin_src emacs-lisp\n(defun a () (b))\n#+end_src\n(defun no ())\n#+begin_src sh\n(x\n#+end_src\n"
    got = brace_source.extract(org, "c.org", "elisp")
    assert [(s["name"], s["start_line"]) for s in got["symbols"]] == [("a", 3)] and [r["target"] for r in got["refs"]] == ["b"]
