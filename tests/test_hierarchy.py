import random

from conftest import SYMBOL
from factloom.operators import hierarchy as h

ROWS = [("a", None), ("b", "a"), ("c", " B "), ("d", ""), ("e", "nowhere"), ("x", "y"), ("y", "X"), ("z", "y"), ("s", "s"), (None, "a"), ("b", "a")]


def table(make, rows):
    return make(SYMBOL, [{"symbol_id": i, "parent_symbol_id": p, "qualified_name": f"q.{i}" if i != "d" else None, "name": i} for i, p in rows])


def test_circular(make):
    assert sorted(r[0] for r in h.circular(table(make, ROWS)).collect()) == ["s", "x", "y", "z"]


def test_paths(make):
    got = {r.symbol_id: (r.root_id, r.depth, r.path, r.has_root) for r in h.hierarchy(table(make, ROWS)).collect()}
    assert got["c"] == ("a", 2, "q.a > q.b > q.c", True)
    assert got["d"] == ("d", 0, "d", True) and got["e"] == ("e", 0, "q.e", True)
    assert got["z"] == (None, None, None, False) and len(got) == 9


def test_descendants(make):
    got = {(r.ancestor_id, r.symbol_id, r.distance) for r in h.descendants(table(make, ROWS)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_empty(make):
    t = table(make, [])
    assert h.circular(t).count() == h.hierarchy(t).count() == h.descendants(t).count() == 0


def test_against_brute_force(make):
    rng = random.Random(4)
    ids = [f"n{i}" for i in range(120)]
    rows = [(n, rng.choice([*ids, None, "gone"])) for n in ids] + [(f"k{i}", f"k{i - 1}" if i else None) for i in range(70)]
    parent = {n: p for n, p in rows}
    want, pairs = {}, set()
    for n in parent:
        way, x = [n], n
        while parent.get(x) in parent and parent[x] not in way:
            x = parent[x]
            way.append(x)
        want[n] = None if parent.get(x) in parent else (x, len(way) - 1, " > ".join(f"q.{w}" for w in reversed(way)))
        if want[n]:
            pairs |= {(w, n, k) for k, w in enumerate(way) if k}
    got = {r.symbol_id: (r.root_id, r.depth, r.path) if r.has_root else None for r in h.hierarchy(table(make, rows)).collect()}
    assert got == want
    assert {tuple(r) for r in h.descendants(table(make, rows)).collect()} == pairs


def test_hot_parent_is_broadcast(make, spark, monkeypatch):
    from factloom.operators import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    rows = [("root", None), *[(f"c{i}", "root") for i in range(60)], *[(f"g{i}", f"c{i % 60}") for i in range(40)]]
    got = h.hierarchy(table(make, rows)).collect()
    assert len(got) == 101 and {r.root_id for r in got} == {"root"} and sum(r.depth for r in got) == 60 + 80
