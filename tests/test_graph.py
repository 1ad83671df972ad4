import random

import pytest

from factloom.operators import graph as g


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


PAIRS = [("a", "b"), ("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "c"), ("x", "x"), (None, "a"), ("e", None)]


@pytest.mark.parametrize("small", [0, g.SMALL])
def test_bfs(spark, small):
    got = {tuple(r) for r in g.bfs(edges(spark, PAIRS), nodes(spark, "a"), small=small).collect()}
    assert got == {("a", 0), ("b", 1), ("d", 1), ("c", 2), ("e", 3)}
    assert {tuple(r) for r in g.bfs(edges(spark, PAIRS), nodes(spark, "c"), 1, reverse=True, small=small).collect()} == {("c", 0), ("b", 1), ("d", 1), ("e", 1)}
    assert g.bfs(edges(spark, []), nodes(spark), small=small).count() == 0


def test_walk_and_focus(spark):
    assert {tuple(r) for r in g.traversed(edges(spark, PAIRS), nodes(spark, "a"), 1).collect()} == {("a", "b", 1), ("a", "d", 1)}
    got = dict(tuple(r) for r in g.focus(edges(spark, PAIRS), nodes(spark, "c"), 2).collect())
    assert got == {"c": 0, "e": 1, "b": -1, "d": -1, "a": -2}


def test_tree(spark):
    got = {r.path: (r.recursive, r.truncated) for r in g.call_tree(edges(spark, PAIRS), nodes(spark, "c"), 3).collect()}
    assert got == {"c": (False, False), "c > e": (False, False), "c > e > c": (True, False)}
    got = {r.path: r.truncated for r in g.call_tree(edges(spark, PAIRS), nodes(spark, "a"), 1).collect()}
    assert got == {"a": False, "a > b": True, "a > d": True}


def test_paths(spark):
    got = {(r.path, r.length) for r in g.simple_paths(edges(spark, PAIRS), "a", "c", 4).collect()}
    assert got == {("a > b > c", 2), ("a > d > c", 2)}


@pytest.mark.parametrize("small", [0, g.SMALL])
def test_components_against_brute_force(spark, small):
    rng = random.Random(7)
    pairs = [(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}") for _ in range(60)] + [("p", "q"), ("q", "p"), ("r", "r")]
    reach = {}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    for v in {x for p in pairs for x in p}:
        seen, todo = set(), [v]
        while todo:
            for w in out.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        reach[v] = seen
    want = {}
    for v in reach:
        c = {w for w in reach[v] if v in reach.get(w, ())} | {v}
        if len(c) > 1:
            want[v] = max(c)
    assert dict(tuple(r) for r in g.components(edges(spark, pairs), small).collect()) == want
    level = {r.node: (r.component, r.level) for r in g.layers(edges(spark, pairs), small).collect()}
    for a, b in pairs:
        ca, cb = level[a], level[b]
        assert ca[0] == cb[0] or ca[1] > cb[1]
    assert all(lv == 0 or any(level[b][1] == lv - 1 for x in level if level[x][0] == c for b in out.get(x, ())) for c, lv in level.values())
