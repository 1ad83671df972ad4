"""Traversals of edge tables (src, dst) in rounds driven from the driver.

A round joins the frontier of distinct nodes to the edges, drops what was seen and writes the new frontier to the shared folder,
so lineage stays short and a lost executor costs one round. Distances are exact; nothing is capped but the depth that a caller asks for.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.session import Scratch

#: Edges that one task can walk: some 20 MB. A caller who passes it as ``small`` has graphs of up to so many edges walked at once; by default all go in rounds.
SMALL = 200_000


def _in_one_task(edges: DataFrame, walk, schema: str) -> DataFrame:
    """``walk`` over all (src, dst) rows of a small table, in one task of an executor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        pairs = [p for part in parts for p in zip(part["src"], part["dst"])]
        yield pd.DataFrame(walk(pairs), columns=[x.split()[0] for x in schema.split(", ")])

    return edges.select("src", "dst").coalesce(1).mapInPandas(run, schema)


def _walk_bfs(pairs: list[tuple], depth: int | None) -> list[tuple]:
    """Seeds are the pairs without a target."""
    out, far, layer = defaultdict(list), {}, []
    for a, b in pairs:
        if b is None:
            far[a] = 0
        else:
            out[a].append(b)
    layer, k = list(far), 0
    while layer and (depth is None or k < depth):
        k += 1
        layer = [b for b in {b for a in layer for b in out.get(a, ())} if b not in far]
        far.update(dict.fromkeys(layer, k))
    return list(far.items())


def _tarjan(pairs: list[tuple]) -> dict:
    """Each node's component as the list of its nodes, successors' components first."""
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
        out[b]
    index, low, on, stack, comps = {}, {}, set(), [], []
    for root in list(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp.append(w)
                        if w == v:
                            break
                    comps.append(comp)
    return {"out": out, "comps": comps}


def _walk_components(pairs: list[tuple]) -> list[tuple]:
    return [(v, max(c)) for c in _tarjan(pairs)["comps"] if len(c) > 1 for v in c]


def _walk_layers(pairs: list[tuple]) -> list[tuple]:
    found = _tarjan(pairs)
    head = {v: max(c) for c in found["comps"] for v in c}
    level: dict = {}
    for c in found["comps"]:  # a component comes after all that it leads to
        level[head[c[0]]] = max((level[head[w]] + 1 for v in c for w in found["out"][v] if head[w] != head[c[0]]), default=0)
    return [(v, h, level[h]) for v, h in head.items()]


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None = None, reverse: bool = False, scratch: Scratch | None = None, small: int = 0) -> DataFrame:
    """(node, distance): nodes reached from ``seeds`` (node) by at most ``depth`` edges, each at its shortest distance; seeds at 0."""
    scratch = scratch or Scratch(edges.sparkSession, "bfs")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = scratch.save(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    if small and steps.count() <= small:
        starts = scratch.save(seeds.where(F.col("node").isNotNull()).select("node").distinct())
        if starts.count() <= small:
            pairs = steps.select(F.col("node").alias("src"), F.col("next").alias("dst")).unionByName(starts.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")))
            return _in_one_task(pairs, lambda p: _walk_bfs(p, depth), "node string, distance int")
    layer = scratch.save(seeds.where(F.col("node").isNotNull()).select("node").distinct().withColumn("distance", F.lit(0)))
    seen, k, n = [layer], 0, 1
    while (depth is None or k < depth) and n:
        k += 1
        fresh = layer.select("node").join(steps, "node").select(F.col("next").alias("node")).distinct()
        # every neighbour of the last layer is seen or new; in directed graphs it may be in any earlier layer
        fresh = fresh.join(_all(seen).select("node"), "node", "left_anti")
        layer, n = scratch.save_counted(fresh.withColumn("distance", F.lit(k)))
        seen.append(layer)
    return _all(seen)


def reach_each(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(origin, node, distance): what each seed (node) reaches by at most ``depth`` edges, itself at 0."""
    scratch = Scratch(edges.sparkSession, "each")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = scratch.save(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    layer = out = scratch.save(seeds.where(F.col("node").isNotNull()).select(F.col("node").alias("origin"), "node").distinct().withColumn("distance", F.lit(0)))
    for k in range(1, depth + 1):
        step = layer.join(steps, "node").select("origin", F.col("next").alias("node")).distinct()
        layer, n = scratch.save_counted(step.join(out.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("distance", F.lit(k)))
        if not n:
            break
        out = out.unionByName(layer)
    return out


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def traversed(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(src, dst, distance): the edges walked forward from ``roots`` within ``depth``; one between two last-layer nodes is not walked."""
    scratch = Scratch(edges.sparkSession, "walk")
    reached = bfs(edges, roots, depth, scratch=scratch).where(F.col("distance") < depth)
    return edges.join(reached.withColumnRenamed("node", "src"), "src").select("src", "dst", (F.col("distance") + 1).alias("distance"))


def focus(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, distance): positive where a seed depends on the node, negative where it depends on a seed; positive on a tie."""
    scratch = Scratch(edges.sparkSession, "focus")
    ahead = bfs(edges, seeds, depth, scratch=scratch).withColumnRenamed("distance", "ahead")
    back = bfs(edges, seeds, depth, reverse=True, scratch=scratch).withColumnRenamed("distance", "back")
    both = ahead.join(back, "node", "full_outer")
    nearer = F.col("ahead").isNotNull() & (F.col("back").isNull() | (F.col("ahead") <= F.col("back")))
    return both.select("node", F.when(nearer, F.col("ahead")).otherwise(-F.col("back")).alias("distance"))


def call_tree(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(path, node, depth, recursive, truncated): the tree of calls below each root.

    A node that is among its own ancestors is recursive and not expanded; at the depth limit a node is truncated if it has edges.
    Siblings repeat, as it is a tree. path holds the nodes joined by ' > '.
    """
    scratch = Scratch(edges.sparkSession, "tree")
    steps = scratch.save(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct())
    layer = scratch.save(roots.select(F.array("node").alias("way"), F.col("node"), F.lit(False).alias("recursive")).distinct())
    out = [layer.withColumn("depth", F.lit(0))]
    for k in range(1, depth + 1):
        open_ = layer.where(~F.col("recursive")).select("way", F.col("node").alias("src"))
        layer = open_.join(steps, "src").select(F.concat("way", F.array("dst")).alias("way"), F.col("dst").alias("node"), F.array_contains("way", F.col("dst")).alias("recursive"))
        layer = scratch.save(layer)
        out.append(layer.withColumn("depth", F.lit(k)))
    has = steps.select(F.col("src").alias("node")).distinct().withColumn("more", F.lit(True))
    tree = _all(out).join(has, "node", "left")
    cut = (F.col("depth") == depth) & ~F.col("recursive") & F.coalesce("more", F.lit(False))
    return tree.select(F.array_join("way", " > ").alias("path"), "node", "depth", "recursive", cut.alias("truncated"))


def simple_paths(edges: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """(path, length): simple paths from source to target of at most ``depth`` edges, which end at the first hit of the target.

    Only nodes from which the target is within reach are entered, so what is enumerated is not more than what can still arrive.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "paths")
    near = bfs(edges, spark.createDataFrame([(target,)], "node string"), depth, reverse=True, scratch=scratch)
    steps = scratch.save(edges.select("src", "dst").distinct().join(near.select(F.col("node").alias("dst"), F.col("distance").alias("left")), "dst"))
    layer, out = spark.createDataFrame([([source], source)], "way array<string>, node string"), []
    for k in range(1, depth + 1):
        layer = layer.where(F.col("node") != target) if k > 1 else layer
        layer = layer.withColumnRenamed("node", "src").join(steps.where(F.col("left") <= depth - k), "src").where(~F.array_contains("way", F.col("dst")))
        layer = scratch.save(layer.select(F.concat("way", F.array("dst")).alias("way"), F.col("dst").alias("node")))
        out.append(layer.where(F.col("node") == target).select(F.array_join("way", " > ").alias("path"), F.lit(k).alias("length")))
    return _all(out)


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """(node, component): the strongly connected components of more than one node, named by their greatest node.

    Nodes without edges in or out are trimmed first, round by round. Then every node takes two colours, the greatest node that reaches it and the
    greatest that it reaches. Where both are one node, it lies on a circle with it and leaves; the rest goes round again without the edges between different colours.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    rest = scratch.save(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    if small and rest.count() <= small:
        return _in_one_task(rest, _walk_components, "node string, component string")
    found: list[DataFrame] = []
    while True:
        rest = _trim(rest, scratch)
        if rest.isEmpty():
            break
        # the greatest node that reaches a node and the greatest that it reaches: if they are the same, the node lies on a circle with it
        pair = scratch.save(_spread(rest, scratch).join(_spread(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")), scratch).withColumnRenamed("colour", "back"), "node"))
        found.append(pair.where(F.col("colour") == F.col("back")).select("node", F.col("colour").alias("component")))
        # members of one component have the same pair of colours; edges between others lead out of components
        left = pair.where(F.col("colour") != F.col("back"))
        a = left.select(F.col("node").alias("src"), F.col("colour").alias("c1"), F.col("back").alias("b1"))
        z = left.select(F.col("node").alias("dst"), F.col("colour").alias("c2"), F.col("back").alias("b2"))
        rest = scratch.save(rest.join(a, "src").join(z, "dst").where((F.col("c1") == F.col("c2")) & (F.col("b1") == F.col("b2"))).select("src", "dst"))
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    out = _all(found)
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return out.join(sizes.select("component"), "component").select("node", "component")


def _trim(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges of which both ends have an edge in and an edge out, round by round until none goes."""
    n = rest.count()
    while n:
        heads, tails = rest.select(F.col("dst").alias("src")).distinct(), rest.select(F.col("src").alias("dst")).distinct()
        kept, m = scratch.save_counted(rest.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        scratch.drop(rest)
        rest, done, n = kept, m == n, m
        if done:
            break
    return rest


def _raised(state: DataFrame, edges: DataFrame, scratch: Scratch, step: int) -> DataFrame:
    """(node, value): the greatest value at fixpoint, where a node offers its value plus ``step`` along its edges. Only nodes whose value rose offer it again.

    state: (node, value); edges: (node, next). A round is one written table.
    """
    state = scratch.save(state.withColumn("rose", F.lit(True)))
    while True:
        fresh = state.where("rose").select("node", (F.col("value") + step if step else F.col("value")).alias("offer"))
        offers = fresh.join(edges, "node").select(F.col("next").alias("node"), "offer")
        offers = offers.groupBy("node").agg(F.max("offer").alias("offer"))
        rose = F.coalesce(F.col("offer") > F.col("value"), F.lit(False))
        old = state
        state, n = scratch.save_counted(old.drop("rose").join(offers, "node", "left").select("node", F.when(rose, F.col("offer")).otherwise(F.col("value")).alias("value"), rose.alias("rose")), "rose")
        scratch.drop(old)
        if not n:
            return state.drop("rose")


def _spread(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, colour): the greatest node that reaches each node, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    found = _raised(nodes.withColumn("value", F.col("node")), edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), scratch, 0)
    return found.withColumnRenamed("value", "colour")


def layers(edges: DataFrame, small: int = 0) -> DataFrame:
    """(node, component, level): sinks of the condensed graph have level 0, others one more than their highest successor."""
    scratch = Scratch(edges.sparkSession, "layers")
    edges = scratch.save(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct())
    if small and edges.count() <= small:
        return _in_one_task(edges, _walk_layers, "node string, component string, level int")
    comp = scratch.save(components(edges, small))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    group = scratch.save(nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    up = edges.join(group.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(group.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    dag = scratch.save(up.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    zero = group.select(F.col("component").alias("node")).distinct().withColumn("value", F.lit(0))
    level = _raised(zero, dag.select(F.col("b").alias("node"), F.col("a").alias("next")), scratch, 1)
    return group.join(level.select(F.col("node").alias("component"), F.col("value").alias("level")), "component").select("node", "component", "level")
