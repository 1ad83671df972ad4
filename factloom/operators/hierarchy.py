"""Parent-child links to full hierarchies by pointer doubling.

Each node holds a pointer to an ancestor. A round joins the pointers to themselves and so
doubles their distance: after k rounds every node of depth below 2**k has met its root. If
a round resolves no node, none that is left has a root: were there one of finite depth d >= 2**k, its
ancestor of depth 2**(k-1) .. 2**k - 1 would have been resolved in that round. So the rest lies on or
below a circle, and the number of rounds is logarithmic in the true depth, not in the table's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.skew import find_hot, lookup_join
from factloom.session import Scratch
from factloom.sources.tables import distinct_symbols

SEPARATOR = " > "


def links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, pid): each node with its known parent; null, empty and unknown parents are null."""
    known = nodes.select(F.col("sid").alias("pid"), F.lit(True).alias("_is"))
    n = nodes.where(F.col("pid").isNotNull()).count()
    hot = find_hot(nodes, "pid", n, scratch)
    joined = lookup_join(nodes.where(F.col("pid").isNotNull()), known, "pid", hot)
    with_parent = joined.select("sid", F.when(F.col("_is"), F.col("pid")).alias("pid"))
    return scratch.save(with_parent.unionByName(nodes.where(F.col("pid").isNull()).select("sid", "pid")))


def roots(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Resolve (sid, pid) links.

    Returns (sid, root, depth) of every node with a root, and (sid) of the nodes without.
    """
    done = [edges.where(F.col("pid").isNull()).select("sid", F.col("sid").alias("root"), F.lit(0).cast("long").alias("depth"))]
    active = scratch.save(edges.where(F.col("pid").isNotNull()).select("sid", F.col("pid").alias("anc"), F.lit(1).cast("long").alias("hops")))
    n = active.count()
    while n:
        # what a pointer leads to: a node that is still on its way, or else a resolved one
        ahead = active.select(F.col("sid").alias("anc"), F.col("anc").alias("far"), F.col("hops").alias("more"), F.lit(None).cast("string").alias("root"))
        for d in done:
            ahead = ahead.unionByName(d.select(F.col("sid").alias("anc"), F.lit(None).cast("string").alias("far"), F.col("depth").alias("more"), "root"))
        hot = find_hot(active, "anc", n, scratch)
        step = scratch.save(lookup_join(active, ahead, "anc", hot).select("sid", "far", "root", (F.col("hops") + F.col("more")).alias("hops")))
        met = step.where(F.col("root").isNotNull()).select("sid", "root", F.col("hops").alias("depth"))
        active = step.where(F.col("root").isNull()).select("sid", F.col("far").alias("anc"), "hops")
        left = active.count()
        if left == n:
            break
        done.append(met)
        n = left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, active.select("sid")


def circular(symbols: DataFrame) -> DataFrame:
    """(symbol_id): symbols whose chain of parents never ends, each once, as spelled in the table.

    Rows without symbol_id are no nodes. A self parent is a circle. An empty table gives no rows.
    """
    scratch = Scratch(symbols.sparkSession, "hierarchy")
    nodes = scratch.save(distinct_symbols(symbols.select("symbol_id", "parent_symbol_id")))
    _, loose = roots(links(nodes, scratch), scratch)
    return loose.join(nodes.select("sid", "symbol_id"), "sid").select("symbol_id")


def hierarchy(symbols: DataFrame) -> DataFrame:
    """(symbol_id, root_id, depth, path, has_root) of every symbol.

    path joins the qualified names from the root down (names, then ids, stand in for null or
    empty ones) with " > ". Symbols on or below a circle have null root_id, depth and path. Paths are
    concatenated only for nodes with a root, so no segment is repeated endlessly.
    """
    scratch = Scratch(symbols.sparkSession, "hierarchy")
    nodes = scratch.save(distinct_symbols(symbols.select("symbol_id", "parent_symbol_id", "qualified_name", "name")))
    edges = links(nodes, scratch)
    rooted, loose = roots(edges, scratch)
    rooted = scratch.save(rooted)
    shown = lambda c: F.when(F.length(F.trim(F.col(c))) > 0, F.col(c))
    label = nodes.select("sid", F.coalesce(shown("qualified_name"), shown("name"), F.col("symbol_id")).alias("path"))
    state = scratch.save(edges.join(rooted.select("sid", "depth"), "sid").join(label, "sid").select("sid", F.col("pid").alias("anc"), "path", "depth"))
    n = state.where(F.col("anc").isNotNull()).count()
    finished = [state.where(F.col("anc").isNull()).select("sid", "path")]
    while n:
        active = state.where(F.col("anc").isNotNull())
        ahead = state.select(F.col("sid").alias("anc"), F.col("anc").alias("far"), F.col("path").alias("above"))
        for d in finished[:-1] if len(finished) > 1 else []:
            ahead = ahead.unionByName(d.select(F.col("sid").alias("anc"), F.lit(None).cast("string").alias("far"), F.col("path").alias("above")))
        hot = find_hot(active, "anc", n, scratch)
        state = scratch.save(lookup_join(active, ahead, "anc", hot).select("sid", F.col("far").alias("anc"), F.concat_ws(SEPARATOR, "above", "path").alias("path"), "depth"))
        finished.append(state.where(F.col("anc").isNull()).select("sid", "path"))
        n = state.where(F.col("anc").isNotNull()).count()
    paths = finished[0]
    for d in finished[1:]:
        paths = paths.unionByName(d)
    id_of = nodes.select("sid", "symbol_id")
    full = rooted.join(paths, "sid", "left").join(id_of, "sid").select("symbol_id", F.col("root").alias("root_id"), "depth", "path", F.lit(True).alias("has_root"))
    none = loose.join(id_of, "sid").select("symbol_id", F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("has_root"))
    return full.unionByName(none)


def descendants(symbols: DataFrame) -> DataFrame:
    """(ancestor_id, symbol_id, distance): every symbol below each symbol, distance 1 and more.

    Closed by the same doubled pointers: all ancestors at distance below 2**k, joined with the pointers of
    distance 2**k, give all at distance below 2**(k+1). Symbols without a root are left out, as
    their ancestors would repeat for ever. The result has as many rows as there are pairs, the sum of all depths.
    """
    scratch = Scratch(symbols.sparkSession, "descendants")
    nodes = scratch.save(distinct_symbols(symbols.select("symbol_id", "parent_symbol_id")))
    edges = links(nodes, scratch)
    rooted, _ = roots(edges, scratch)
    rooted = scratch.save(rooted)
    pointer = scratch.save(edges.join(rooted.select("sid"), "sid", "left_semi").where(F.col("pid").isNotNull()).select("sid", F.col("pid").alias("anc")))
    pairs, distance = pointer.select("sid", "anc", F.lit(1).cast("long").alias("distance")), 1
    pairs = scratch.save(pairs)
    while not pointer.isEmpty():
        # pairs holds distances 1 .. distance, pointer leads up by exactly distance
        far = pointer.select(F.col("sid").alias("anc"), F.col("anc").alias("far"))
        m = pairs.count()
        hot = find_hot(pairs, "anc", m, scratch)
        longer = lookup_join(pairs, far, "anc", hot, "inner").select("sid", F.col("far").alias("anc"), (F.col("distance") + distance).alias("distance"))
        longer = scratch.save(longer)
        pairs = pairs.unionByName(longer)
        pointer = longer.where(F.col("distance") == 2 * distance).select("sid", "anc")
        distance *= 2
    return pairs.select(F.col("anc").alias("ancestor_id"), F.col("sid").alias("symbol_id"), "distance")
