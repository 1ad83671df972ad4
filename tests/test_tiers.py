"""Resolution of names across planted files."""

from factloom.operators import tiers
from factloom.session import Scratch
from factloom.sources import python_source
from factloom.sources.python_keys import keys

FILES = {
    "pkg/__init__.py": "from .models import Base, helper\nfrom pkg.deep import *\n",
    "pkg/deep.py": "from pkg.models import Base as Root\ndef only():\n    pass\n",
    "pkg/models.py": "class Base:\n    def save(self):\n        self.touch()\n        self.gone()\n    def touch(self):\n        pass\n    @cached\n    def late(self):\n        pass\nclass Other(Base):\n    def touch(self):\n        super().touch()\n        super().save()\ndef helper():\n    pass\n@wrap\ndef wrapped():\n    pass\n",
    "app/main.py": "import os, json\nimport pkg\nfrom pkg import Base, helper\nfrom pkg.models import Other, wrapped\nfrom x.y import Far\nclass Mine(Other):\n    def __init__(self, store: 'Base', far: Far):\n        self.other = Other()\n        self.store = store\n    def run(self, item: Base, n):\n        self.save()\n        self.other.touch()\n        item.touch()\n        n.touch()\n        helper()\n        pkg.helper()\n        pkg.missing()\n        os.path.join('a')\n        json.loads('x').strip()\n        wrapped()\n        len('x')\n        nowhere()\n        def inner():\n            pass\n        inner()\n        x = Other()\n        x.late()\n        y = json.loads('x')\n        y.keys()\n        f = Far()\n        f.go()\nclass Lost(Far):\n    def a(self):\n        self.b()\n",
    "app/star.py": "from pkg.models import *\nfrom pkg.deep import *\nhelper()\nonly()\nRoot()\nno_such()\n",
    "tools/a/dup.py": "def twin():\n    pass\n",
    "tools/b/dup.py": "def twin():\n    pass\n",
    "tools/use.py": "import dup\nfrom a import dup as d\ndup.twin()\nd.twin()\n",
}


def resolved(spark):
    symbols, refs, exports = [], [], []
    for path, text in FILES.items():
        for s in python_source.extract(text, path).symbols:
            symbols.append((s["qname"], s["qname"], s["name"], s["kind"], s["decorators"]))
        r, e = keys(text, path)
        refs += [(path, x["source"], x["kind"], x["key"], x["a"], x["b"], x["line"], x["name"], x["position"]) for x in r]
        exports += [(x["module"], x["name"], x["target"]) for x in e]
    s = spark.createDataFrame(symbols, "sid string, qname string, name string, kind string, decorators array<string>")
    r = spark.createDataFrame(refs, "file_id string, source string, kind string, key string, a string, b string, line int, name string, position int")
    e = spark.createDataFrame(exports, "module string, name string, target string")
    return {(x.source, x.name): (x.target_id, x.status, x.confidence, x.reason) for x in tiers.resolve_keys(r, s, e).collect()}, len(refs), tiers.resolve_keys(r.limit(0), s.limit(0), e.limit(0)).count()


def test_python_tiers(spark):
    got, n, none = resolved(spark)
    run = lambda name: got["app.main.Mine.run", name][:3]
    assert none == 0 and len(got) <= n
    # re-exports of packages
    assert run("helper") == ("pkg.models.helper", "resolved", "confirmed") and run("pkg.helper") == ("pkg.models.helper", "resolved", "confirmed") and got["app.main.Mine.run", "helper"][3] == "re-export"
    assert got["app.main.Mine.run", "pkg.missing"][1] == "unresolved" and got["app.main.Mine.run", "pkg.missing"][3] == "no such member"
    # self and super along the bases
    assert run("self.save") == ("pkg.models.Base.save", "resolved", "inferred") and got["pkg.models.Base.save", "self.touch"][0] == "pkg.models.Base.touch"
    assert got["pkg.models.Other.touch", "super().touch"][0] == "pkg.models.Base.touch" and got["pkg.models.Other.touch", "super().save"][0] == "pkg.models.Base.save"
    assert got["pkg.models.Base.save", "self.gone"][1:] == ("unresolved", "inferred", "no such method") and got["app.main.Lost.a", "self.b"][3] == "a base is unknown"
    # types of attributes, parameters and locals
    assert run("self.other.touch") == ("pkg.models.Other.touch", "resolved", "inferred") and run("item.touch")[0] == "pkg.models.Base.touch" and run("x.late")[0] == "pkg.models.Base.late"
    assert run("n.touch")[1] == "unresolved" and got["app.main.Mine.run", "y.keys"][1] == "unresolved" and got["app.main.Mine.run", "f.go"][1:] == ("external", "inferred", "type outside the project")
    # the rest
    assert run("os.path.join")[1] == "external" and run("len")[1] == "external" and run("nowhere")[1] == "unresolved" and run("inner") == ("app.main.Mine.run.inner", "resolved", "inferred")
    assert run("wrapped") == ("pkg.models.wrapped", "resolved", "inferred") and got["app.main.Mine", "Other"][:3] == ("pkg.models.Other", "resolved", "confirmed")
    star = lambda name: got["app.star", name][:2]
    assert star("helper") == ("pkg.models.helper", "resolved") and star("only") == ("pkg.deep.only", "resolved") and star("Root") == ("pkg.models.Base", "resolved") and star("no_such") == (None, "unresolved")
    assert got["tools.use", "dup.twin"][1] == "ambiguous" and got["tools.use", "d.twin"][:3] == ("tools.a.dup.twin", "resolved", "inferred")


def test_keys_of_odd_sources():
    assert keys("def f(:\n", "a.py") == ([], []) and keys("", "a.py") == ([], []) and keys("﻿f()\r\n", "a.py")[0][0]["key"] == "none"
    (r,) = keys("from ....far import x\nx()\n", "a/b.py")[0]
    assert (r["key"], r["a"]) == ("none", "no binding")
    found = {r["name"]: r["key"] for r in keys("import a\nv = a.B()\nv.go()\nclass C:\n    def f(self):\n        for q in []:\n            q.go()\n        (lambda: 1)()\n        [1].sort()\n", "m.py")[0]}
    assert found["v.go"] == "typed" and found["q.go"] == "none" and found[""] == "none"


def test_linearize_breadth_first(spark):
    bases = spark.createDataFrame([("d", 0, "b"), ("d", 1, "c"), ("b", 0, "a"), ("c", 0, "x"), ("c", 1, "a"), ("x", 0, "d"), ("a", 0, None)], "cls string, position int, base string").where("base IS NOT NULL")
    got = tiers.linearize(bases, spark.createDataFrame([("d",), ("lone",)], "cls string"), Scratch(spark, "t")).orderBy("cls", "distance", "way").collect()
    assert [r.base for r in got if r.cls == "d"] == ["d", "b", "c", "a", "x"] and [r.base for r in got if r.cls == "lone"] == ["lone"]


def test_other_languages(spark):
    calls = spark.createDataFrame([(1, "f", "Get"), (2, "f", "Put"), (3, "g", "Put"), (4, "f", "Nope"), (5, "f", "Two")], "call int, file_id string, name string")
    methods = spark.createDataFrame([("m1", "Get", "p"), ("m2", "Put", "q"), ("m3", "Two", "p"), ("m4", "Two", "p")], "sid string, name string, package string")
    reach = spark.createDataFrame([("f", "p"), ("g", "p"), ("g", "q")], "file_id string, package string")
    assert {r.call: (r.target, r.status) for r in tiers.go_methods(calls, methods, reach).collect()} == {1: ("m1", "resolved"), 2: (None, "unresolved"), 3: ("m2", "resolved"), 4: (None, "external"), 5: (None, "ambiguous")}
    calls = spark.createDataFrame([(1, "u1", False, False), (2, "u2", False, True), (3, "u3", False, False), (4, "u1", True, False), (5, "ux", True, False), (6, "u4", False, False), (7, None, False, False)], "call int, usr string, system boolean, virtual boolean")
    symbols = spark.createDataFrame([("d1", "u1", "function"), ("p1", "u1", "function_declaration"), ("d2", "u2", "method"), ("a", "u3", "function"), ("b", "u3", "function"), ("p4", "u4", "function_declaration"), ("n", None, "function")], "sid string, usr string, kind string")
    got = {r.call: (r.target, r.status, r.confidence) for r in tiers.by_usr(calls, symbols).collect()}
    assert got == {1: ("d1", "resolved", "confirmed"), 2: ("d2", "resolved", "inferred"), 3: (None, "ambiguous", "inferred"), 4: (None, "ambiguous", "inferred"), 5: (None, "external", "inferred"), 6: ("p4", "resolved", "confirmed"), 7: (None, "external", "inferred")}
    got = {r.call: (r.target, r.status) for r in tiers.by_global_name(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "call int, name string"), spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "sid string, name string")).collect()}
    assert got == {1: ("a", "resolved"), 2: (None, "ambiguous"), 3: (None, "external")}


def test_function_pointers(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    calls = df([(1, "s.op"), (2, "s.one"), (3, "s.fog"), (4, "s.none"), (5, "p.cb")], "call int, slot string")
    bindings = df([("s.op", "f"), ("s.op", "g"), ("s.one", "f"), ("s.fog", "f"), ("q.cb", "h")], "slot string, sid string")
    links = df([("p.cb", "o.cb"), ("o.cb", "q.cb"), ("q.cb", "p.cb")], "slot string, source string")
    got = {r.call: (r.target, r.status, r.n) for r in tiers.resolve_slots(calls, bindings, links, df([("s.fog",)], "slot string")).collect()}
    assert got == {1: (None, "ambiguous", 2), 2: ("f", "resolved", 1), 3: (None, "ambiguous", 1), 4: (None, "unresolved", 0), 5: ("h", "resolved", 1)}
