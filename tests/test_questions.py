"""Composite questions against their SQL on the smallest tables, and comparisons with other tools' views on planted rows."""

import pytest
from test_queries import DATA, con, rows  # noqa: F401

import __spark_entry__ as entry
from factloom.operators import graph, questions as qs

NAMES = ["u_unused_ranked", "g_parent_walk", "u_externals", "g_effects_routes", "g_impact_routes", "g_callers_usr", "g_arch", "u_understand", "o_budget", "o_early_stop", "src_visible", "g_linearize", "r_go", "r_c", "r_el", "s_query_terms", "s_split_terms"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, rows, name):  # noqa: F811
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("path, test", [("tests/a.py", True), ("test/x.c", True), ("a/testing", True), ("spec/a.py", False), ("a/test_b.py", True), ("a/test_b.c", False), ("b_test.py", True), ("conftest.py", True), ("Tests/a.py", False), ("latest/a.py", False), (None, False)])
def test_paths_of_tests(spark, path, test):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(qs.is_test(df.path)).first()[0] is test


def test_binary(spark):
    df = spark.createDataFrame
    files = df([("f1", "src/a.c"), ("f2", "lib/a.c"), ("f3", "src/b.c")], "file_id string, path string")
    assert {tuple(r) for r in qs.match_binary_files(df([("../src/a.c",), ("a.c",), ("b.c",), ("none.c",), ("src\\b.c",)], "name string"), files).collect()} == {("../src/a.c", "f1"), ("b.c", "f3"), ("src\\b.c", "f3")}
    symbols = df([("s1", "run", "src/a.c", "f1"), ("s2", "run", "lib/a.c", "f2"), ("s3", "stop", "src/b.c", "f3"), ("s4", "_start", "src/b.c", "f3"), ("s5", "idle", "src/b.c", "f3"), ("s6", "far", "lib/a.c", "f2")], "sid string, name string, path string, file_id string")
    functions = df([("sym.run", ["run"], "src/a.c"), ("sym.run2", ["run"], None), ("sym.stop", ["nope", "stop"], "b.c"), ("sym.far", ["far"], "other.c"), ("sym.gone", ["gone"], None), ("sym._start", ["_start", "start"], None)], "name string, candidates array<string>, file string")
    m = qs.match_binary_symbols(functions, symbols)
    assert {r.name: (r.state, r.sid, r.n) for r in m.collect()} == {"sym.run": ("matched", "s1", 1), "sym.run2": ("ambiguous", None, 2), "sym.stop": ("matched", "s3", 1), "sym.far": ("binary_only", None, 0), "sym.gone": ("binary_only", None, 0), "sym._start": ("matched", "s4", 1)}
    assert {tuple(r) for r in qs.binary_functions(m, symbols).where("state = 'source_only'").collect()} == {("idle", "source_only")}
    edges = lambda x: df(x, "src string, dst string")
    got = {tuple(r) for r in qs.compare_edges(edges([("a", "b"), ("a", "c"), ("z", "c"), ("a", "q")]), edges([("a", "b"), ("b", "c"), ("a", "b")]), df([(x,) for x in "abcz"], "node string")).collect()}
    assert got == {("a", "b", "both"), ("b", "c", "other_only"), ("a", "c", "static_only")}


def test_index(spark):
    df = spark.createDataFrame
    refs = df([("r1", "a.py", 3, "m.f", "s1", "resolved"), ("r2", "a.py", 4, "g", "s2", "resolved"), ("r3", "a.py", 5, "h", None, "unresolved"), ("r4", "a.py", 6, "x", None, "external"), ("r5", "a.py", 7, "nothing", "s1", "resolved")], "reference_id string, path string, line int, name string, dst string, own string")
    occ = df([("a.py", 3, "f", "F"), ("a.py", 4, "g", "G"), ("a.py", 5, "h", "H"), ("a.py", 6, "x", "X"), ("a.py", 3, "f", "F")], "path string, line int, name string, symbol string")
    defs = df([("F", "b.py", 12), ("G", "b.py", 99), ("H", "b.py", 1)], "symbol string, path string, line int")
    symbols = df([("s1", "b.py", 10, 20), ("s2", "b.py", 30, 40)], "sid string, path string, start_line int, end_line int")
    got = qs.compare_index(refs, occ, defs, symbols)
    assert {r.reference_id: r.state for r in got.collect()} == {"r1": "confirmed", "r2": "conflict", "r3": "index_resolves", "r4": "external", "r5": "no_occurrence"}
    assert {tuple(r) for r in qs.index_states(got).collect()} >= {("resolved", "confirmed", 1), ("resolved", "no_occurrence", 1)}


def test_overlay_and_evaluation(spark):
    df = spark.createDataFrame
    got = {tuple(r) for r in qs.overlay(df([("a", "b", "confirmed"), ("a", "c", "inferred")], "src string, dst string, style string"), df([("a", "b", 2), ("a", "b", 3), ("x", "y", 1)], "src string, dst string, n int"), df([("a", "b")], "src string, dst string")).collect()}
    assert got == {("a", "b", "confirmed", 5), ("a", "c", "inferred", 0), ("x", "y", "observed", 1), ("a", "b", "ai", 0)}
    r = qs.evaluate(df([("ok", True, 2, 3, 1.0), ("ok", False, 1, 3, None), ("bad", True, 0, 0, 0.5)], "status string, passed boolean, valid int, cited int, recall double")).first()
    assert (r.n, round(r.pass_rate, 3), r.citation_validity, r.recall) == (3, 0.667, 0.5, 0.75)
    cited = df([("c1", "a.py", 5, 9), ("c2", "a.py", 1, 2)], "case string, path string, start int, end int")
    want = df([("c1", "a.py", 9, 12), ("c1", "b.py", 1, 2), ("c2", "a.py", 2, 3)], "case string, path string, start int, end int")
    answers = df([("c1", "Uses the Cache."), ("c2", "Plain queue."), ("c3", "Nothing")], "case string, text string")
    words = df([("c1", "cache", False), ("c1", "lock", True), ("c2", "queue", False), ("c2", "plain", True)], "case string, word string, forbidden boolean")
    assert {r.case: (r.evidence, r.terms, r.forbidden, r.passed) for r in qs.score_answers(cited, want, answers, words).collect()} == {"c1": (0.5, 1.0, 0, False), "c2": (1.0, 1.0, 1, False), "c3": (None, None, 0, True)}
    e = df([("e1", {"a": "1", "b": "2"}), ("e2", {"a": "1"})], "explanation_id string, sources map<string,string>")
    assert [tuple(r) for r in qs.stale_explanations(e, df([("a", "1"), ("c", "3")], "path string, hash string")).collect()] == [("e1", "b")]


def test_budget_and_each(spark):
    items = spark.createDataFrame([("g", f"{i:03}", 3) for i in range(50)] + [("h", "a", 99), ("h", "b", None), ("i", "z", 0)], "g string, k string, size int")
    got = qs.within_budget(items, ["g"], [items.k.asc()], "size", 10, "k").select("g", "k", "total").collect()
    assert {tuple(r) for r in got} == {("g", "000", 3), ("g", "001", 6), ("g", "002", 9), ("i", "z", 1)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",), (None,)], "node string")
    assert {tuple(r) for r in graph.reach_each(edges, seeds, 2).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("x", "x", 0), ("x", "b", 1), ("x", "c", 2)}
    assert {tuple(r) for r in graph.reach_each(edges, seeds, 9, reverse=True).where("origin = 'x'").collect()} == {("x", "x", 0)}
