"""Analyses across functions: where exceptions end up, where values go and come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import suffixes
from factloom.operators.graph import bfs
from factloom.session import Scratch


def exception_flow(exceptions: DataFrame, calls: DataFrame, depth: int = 5, bases: DataFrame | None = None) -> DataFrame:
    """(qname, exception, origin, line, distance): exceptions that leave each function, its own at distance 0.

    exceptions: rows (qname, what, name, line, end_line, caught) of raises and guards; calls: (source, target, line) of resolved calls. An exception passes a
    call unless a try of the caller around the call's line catches its name, one of its ``bases`` (name, base), everything, Exception or BaseException. Each
    (function, exception, origin, line) is kept at its least distance, whatever the order in which functions are visited.
    """
    scratch = Scratch(exceptions.sparkSession, "exceptions")
    own = exceptions.where((F.col("what") == "raise") & ~F.col("caught")).select("qname", F.col("name").alias("exception"), F.col("qname").alias("origin"), "line").distinct()
    if bases is not None:  # an exception that a base of it would catch where it is raised stays in the extractor's hands
        kinds = scratch.save(bases.groupBy(F.col("name").alias("exception")).agg(F.collect_set("base").alias("above")))
    layer = scratch.save(own.withColumn("distance", F.lit(0)))
    # a call passes what no guard around it catches: the names caught at each call, collected per call site
    guard = exceptions.where(F.col("what") == "guard").select(F.col("qname").alias("source"), F.col("name").alias("catches"), F.col("line").alias("a"), F.col("end_line").alias("b"))
    sites = calls.where(F.col("source") != F.col("target")).select("source", "target", F.col("line").alias("at")).distinct()
    inside = sites.join(guard, "source").where((F.col("at") > F.col("a")) & (F.col("at") <= F.col("b"))).groupBy("source", "target", "at").agg(F.collect_set("catches").alias("catches"))
    sites = scratch.save(sites.join(inside, ["source", "target", "at"], "left").select("source", "target", F.coalesce("catches", F.array().cast("array<string>")).alias("catches")))
    out, k = layer, 0
    while k < depth and not layer.isEmpty():
        k += 1
        up = layer.select(F.col("qname").alias("target"), "exception", "origin", "line").join(sites, "target")
        up = up.withColumn("above", F.array().cast("array<string>")) if bases is None else up.join(kinds, "exception", "left").withColumn("above", F.coalesce("above", F.array().cast("array<string>")))
        passes = ~(F.array_contains("catches", F.col("exception")) | F.arrays_overlap("catches", "above") | F.arrays_overlap("catches", F.array(F.lit("*"), F.lit("Exception"), F.lit("BaseException"))))
        up = up.where(passes).select(F.col("source").alias("qname"), "exception", "origin", "line").distinct()
        layer = scratch.save(up.join(out, ["qname", "exception", "origin", "line"], "left_anti").withColumn("distance", F.lit(k)))
        out = out.unionByName(layer)
    return out


def value_edges(variables: DataFrame) -> DataFrame:
    """(src, dst) between variables "function:name": assignments, and arguments that become parameters of functions known by one name.

    variables: rows (qname, what, name, how, line, to). An argument's position counts from the first parameter after self or cls. Calls whose name
    belongs to several functions lead nowhere.
    """
    node = lambda q, n: F.concat_ws(":", q, n)
    inner = variables.where(F.col("how").isin("copy", "derive")).select(node(F.col("qname"), F.col("name")).alias("src"), node(F.col("qname"), F.col("to")).alias("dst"))
    params = variables.where((F.col("what") == "def") & (F.col("how") == "param")).select("qname", "name", F.col("to").cast("int").alias("k"))
    bound = params.where((F.col("k") == 0) & F.col("name").isin("self", "cls")).select("qname", F.lit(1).alias("shift"))
    params = params.join(bound, "qname", "left").select("qname", "name", (F.col("k") - F.coalesce("shift", F.lit(0))).alias("k"))
    names = params.select("qname").union(variables.select("qname")).distinct()
    # a class is called for its __init__
    shown = F.array_union(F.array("qname"), F.when(F.col("qname").endswith(".__init__"), F.array(F.regexp_replace("qname", r"\.__init__$", ""))).otherwise(F.array().cast("array<string>")))
    keys = names.select("qname", F.explode(shown).alias("shown")).select("qname", F.explode(F.array_union(F.array("shown"), suffixes(F.col("shown")))).alias("callee")).distinct()
    one = keys.groupBy("callee").agg(F.min("qname").alias("q"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select("callee", "q")
    args = variables.where(F.col("how") == "call_arg").select("qname", "name", F.regexp_replace(F.regexp_extract("to", r"^(.*)#\w+$", 1), r"^(self|cls)\.", "").alias("callee"), F.regexp_extract("to", r"#(\w+)$", 1).alias("at")).join(one, "callee")
    formal = params.select(F.col("qname").alias("q"), F.col("name").alias("param"), F.col("k").cast("string").alias("at"))
    over = args.join(formal, ["q", "at"]).unionByName(args.where(F.col("at").rlike(r"^[^\d]")).join(formal.drop("at").withColumn("at", F.col("param")), ["q", "at"]))
    return inner.unionByName(over.select(node(F.col("qname"), F.col("name")).alias("src"), node(F.col("q"), F.col("param")).alias("dst"))).distinct()


def trace(variables: DataFrame, seeds: DataFrame, depth: int, upstream: bool = False) -> DataFrame:
    """(node, distance): where the values of ``seeds`` (node = "function:name") go within ``depth`` steps, or with ``upstream`` what they come from."""
    return bfs(value_edges(variables), seeds, depth, reverse=upstream)


def pointer_trace(variables: DataFrame, aliases: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, distance): as trace(), where what a pointer is an alias of takes the pointer's values. aliases: (qname, name, target)."""
    same = aliases.where(F.col("target").rlike(r"^\w+$")).select(F.concat_ws(":", "qname", "name").alias("src"), F.concat_ws(":", "qname", "target").alias("dst"))
    return bfs(value_edges(variables).unionByName(same).unionByName(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), seeds, depth)


def field_uses(fields: DataFrame) -> DataFrame:
    """(name, access, n, n_functions) of struct fields over all files."""
    return fields.groupBy("name", "access").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id", "qname").alias("n_functions"))


def macro_uses(macros: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, n_definitions, n_uses): macros that are called like functions."""
    d = macros.groupBy("name").agg(F.count(F.lit(1)).alias("n_definitions"))
    u = refs.groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("n_uses"))
    return d.join(u, "name", "left").select("name", "n_definitions", F.coalesce("n_uses", F.lit(0)).alias("n_uses"))
