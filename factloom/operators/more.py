"""Further operators: names and terms, call graphs with open ends, inheritance, citations, externals and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.facts import Facts
from factloom.operators.graph import bfs
from factloom.operators.relational import component_of, freshness
from factloom.operators.skew import top_n
from factloom.session import Scratch

#: Words that say nothing about a definition.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "it", "for", "by", "on", "at", "as", "be", "or", "an", "that", "this", "with", "are", "was")
#: Path segments and the roles they stand for.
ROLES = {"cmd": "presentation", "app": "application", "engine": "domain", "core": "domain", "lib": "infrastructure", "internal": "infrastructure", "tools": "tooling", "pkg": "library", "src": "source"}


# -- scalar functions -------------------------------------------------------------------------------------------------


def normalize(word: Column) -> Column:
    """A word in lower case without its English ending: the first of ies, ied, sses, ing, ed, es and s that leaves enough of it."""
    low = F.lower(word)
    n = F.length(low)
    cut = lambda k: low.substr(F.lit(1), n - k)
    return (
        F.when(low.rlike("(ss|us|is)$"), low)
        .when(low.endswith("ies") & (n >= 6), F.concat(cut(3), F.lit("y")))
        .when(low.endswith("ied") & (n >= 6), F.concat(cut(3), F.lit("y")))
        .when(low.endswith("sses") & (n >= 7), cut(2))
        .when(low.endswith("ing") & (n >= 7), cut(3))
        .when(low.endswith("ed") & (n >= 6), cut(2))
        .when(low.endswith("es") & (n >= 6), cut(2))
        .when(low.endswith("s") & (n >= 4), cut(1))
        .otherwise(low)
    )


def terms(text: Column) -> Column:
    """The lower-case terms of a text: letters and digits, two characters or more, no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def role(path: Column) -> Column:
    """The role of the last directory of a path that has one; null if none has."""
    table = F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])
    parts = F.split(path, "/")
    return F.try_element_at(F.filter(F.transform(F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), lambda s: F.try_element_at(table, s)), lambda r: r.isNotNull()), F.lit(1))


def auto_depth(f: Facts, wanted: int = 5) -> DataFrame:
    """(depth): the least depth of 1 to 5 at which files fall into at least ``wanted`` components, else 5. One pass."""
    n = f.files.where(F.col("path").isNotNull()).agg(*[F.count_distinct(component_of(F.col("path"), d)).alias(f"d{d}") for d in range(1, 6)])
    out = F.lit(5)
    for d in range(5, 0, -1):
        out = F.when(F.col(f"d{d}") >= wanted, d).otherwise(out)
    return n.select(out.alias("depth"))


def mentions(text: Column, term: str) -> Column:
    """Whether a text has a term as a word of its own, in any case."""
    return text.rlike("(?i)(^|[^A-Za-z0-9_])" + "".join("\\" + c if not c.isalnum() else c for c in term) + "($|[^A-Za-z0-9_])")


# -- lookups ----------------------------------------------------------------------------------------------------------


def at_line(f: Facts, name: str, line: int) -> DataFrame:
    """Definitions called ``name`` that hold a line; declarations only if there is nothing else."""
    s = f.symbols.where((F.col("name") == name) & F.lit(line).between(F.col("start_line"), F.col("end_line")))
    declared = F.coalesce(F.col("kind").endswith("declaration"), F.lit(False))
    n = s.where(~declared).agg(F.count(F.lit(1)).alias("n")).scalar()
    return s.where(~declared | (n == 0)).select("sid", "qname", "kind")


def suggest(f: Facts, name: str, top: int = 3, cutoff: float = 0.6) -> DataFrame:
    """(name, similarity): the names nearest to a misspelt one, by edit distance against the longer length."""
    n = f.symbols.where(F.col("name").isNotNull()).select("name").distinct()
    longest = F.greatest(F.length("name"), F.lit(len(name)))
    n = n.where(F.abs(F.length("name") - len(name)) <= longest * (1 - cutoff)).withColumn("similarity", F.round(1 - F.levenshtein("name", F.lit(name)) / longest, 6))
    return n.where(F.col("similarity") >= cutoff).orderBy(F.desc("similarity"), "name").limit(top)


def shown(f: Facts, sids: DataFrame, around: int = 2) -> DataFrame:
    """(sid, line, text, inside): the source lines of symbols with some lines around them."""
    s = f.symbols.join(sids, "sid", "left_semi").select("sid", "file_id", "start_line", "end_line")
    t = f.raw("source_texts").where(F.col("content").isNotNull()).join(s.select("file_id").distinct(), "file_id", "left_semi")
    parts = F.split("content", "\n")
    first = F.greatest(F.col("start_line") - around, F.lit(1))
    rows = s.join(t, "file_id").select("sid", "start_line", "end_line", first.alias("a"), F.posexplode(F.slice(parts, first, F.col("end_line") + around - first + 1)).alias("k", "text"))
    line = F.col("a") + F.col("k")
    return rows.select("sid", line.alias("line"), F.regexp_replace("text", "\r$", "").alias("text"), line.between(F.col("start_line"), F.col("end_line")).alias("inside"))


# -- graphs -----------------------------------------------------------------------------------------------------------


def call_graph(f: Facts) -> DataFrame:
    """(src, dst, style, n): calls as edges; open ones end in leaves of their own per caller, external ones in leaves that callers share."""
    r = f.refs_of("src", "dst", "kind", "status", "confidence", "tname").where(F.col("kind") == "call")
    end = F.when((F.col("status") == "resolved") & F.col("dst").isNotNull(), F.col("dst")).when(F.col("status") == "external", F.concat(F.lit("external:"), F.coalesce("tname", F.lit("")))).otherwise(F.concat(F.lit("open:"), F.coalesce("src", F.lit("")), F.lit(":"), F.coalesce("tname", F.lit(""))))
    style = F.when(F.col("status") != "resolved", F.col("status")).otherwise(F.col("confidence"))
    return r.groupBy("src", end.alias("dst"), style.alias("style")).agg(F.count(F.lit(1)).alias("n"))


def first_parents(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, distance, parent): reached nodes with the least parent among those one step nearer."""
    scratch = Scratch(edges.sparkSession, "parents")
    reached = scratch.save(bfs(edges, seeds, depth, scratch=scratch))
    p = reached.select(F.col("node").alias("src"), (F.col("distance") + 1).alias("distance"))
    found = edges.join(p, "src").select(F.col("dst").alias("node"), "distance", "src").join(reached, ["node", "distance"]).groupBy("node", "distance").agg(F.min("src").alias("parent"))
    return reached.join(found, ["node", "distance"], "left")


def extracted(edges: DataFrame, seeds: DataFrame, items: int = 30, depth: int = 5) -> DataFrame:
    """(node, distance, parent, rank, truncated): the nodes to read first around seeds, nearest first, at most ``items`` of them."""
    r = first_parents(edges, seeds, depth)
    n = r.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = r.orderBy("distance", "node").limit(items)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "node")))  # at most ``items`` rows
    return ranked.withColumn("truncated", n > items)


def base_names(f: Facts) -> DataFrame:
    """(name, base, distance): the names of all base classes, direct or not, nearest first, until no new one is found."""
    c = f.symbols.where(F.col("kind").isin("class", "struct")).select("name", F.explode("base_classes").alias("base")).where(F.col("name").isNotNull()).distinct()
    scratch = Scratch(f.spark, "bases")
    c = scratch.save(c)
    layer = out = c.withColumn("distance", F.lit(1))
    k = 1
    while True:
        k += 1
        step = layer.select("name", F.col("base").alias("b")).join(c.select(F.col("name").alias("b"), "base"), "b").select("name", "base").distinct()
        layer = scratch.save(step.join(out, ["name", "base"], "left_anti").withColumn("distance", F.lit(k)))
        if layer.isEmpty():
            return out
        out = out.unionByName(layer)


# -- externals, history, documents ----------------------------------------------------------------------------------------


def declared_and_used(used: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, state): undeclared or unused_declared, of names (name) compared in lower case with - for _."""
    norm = lambda d: d.select(F.regexp_replace(F.lower("name"), "_", "-").alias("name")).where(F.length("name") > 0).distinct()
    u, d = norm(used), norm(declared)
    return u.join(d, "name", "left_anti").withColumn("state", F.lit("undeclared")).unionByName(d.join(u, "name", "left_anti").withColumn("state", F.lit("unused_declared")))


def externals_used(f: Facts) -> DataFrame:
    """(name, n_imports, n_files): top names of external dependencies."""
    d = f.deps.where((F.col("status") == "external") & (F.length("tname") > 0))
    return d.groupBy(F.split("tname", r"[./]")[0].alias("name")).agg(F.count(F.lit(1)).alias("n_imports"), F.count_distinct("file_id").alias("n_files"))


def citations(f: Facts) -> DataFrame:
    """(doc_id, path, start, end, status) of [path:line] and [path:line-line] in documents, against the project's files.

    not_found, else stale (the file has changed since its analysis), else out_of_range, else verified.
    """
    one = F.regexp_extract_all("text", F.lit(r"\[([\w./-]+:\d+(?:-\d+)?)\]"), F.lit(1))
    c = f.raw("documents").select("doc_id", "project_id", F.explode(one).alias("c")).distinct()
    lines = F.split(F.regexp_extract("c", r":(\d+(?:-\d+)?)$", 1), "-")
    c = c.select("doc_id", "project_id", F.regexp_extract("c", r"^(.*):", 1).alias("path"), lines[0].try_cast("int").alias("start"), F.coalesce(F.try_element_at(lines, F.lit(2)), lines[0]).try_cast("int").alias("end"))
    n = f.raw("source_texts").where(F.col("content").isNotNull()).groupBy("file_id").agg(F.max(F.size(F.split("content", "\n"))).alias("n_lines"))
    known = f.files.select("file_id", "project_id", "path").join(freshness(f), "file_id").join(n, "file_id", "left").groupBy("project_id", "path").agg(F.max("state").alias("state"), F.max("n_lines").alias("n_lines"))
    bad = (F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("end") > F.coalesce("n_lines", F.lit(0)))
    status = F.when(F.col("state").isNull(), "not_found").when(F.col("state") == "stale", "stale").when(F.coalesce(bad, F.lit(True)), "out_of_range").otherwise("verified")
    return c.join(known, ["project_id", "path"], "left").select("doc_id", "path", "start", "end", status.alias("status"))


def doc_mentions(f: Facts, per_symbol: int = 5) -> DataFrame:
    """(name, doc_id, line): the first line of a document that mentions a definition in backticks, in at most ``per_symbol`` documents a name, a report's top list."""
    lines = f.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    hit = lines.select("doc_id", "k", F.explode(F.regexp_extract_all("line", F.lit("`([A-Za-z_]\\w{3,})`"), F.lit(1))).alias("name"))
    first = hit.groupBy("name", "doc_id").agg((F.min("k") + 1).alias("line"))
    known = f.symbols.where(F.col("kind").isin("function", "method", "class", "struct")).select("name").distinct()
    return top_n(first.join(known, "name", "left_semi"), ["name"], [F.asc("doc_id")], per_symbol, "doc_id").select("name", "doc_id", "line")


def inferred_edges(f: Facts) -> DataFrame:
    """(a, b, n): definitions that documents name together in one line, where each name belongs to one definition only."""
    known = f.symbols.where(F.col("kind").isin("function", "method", "class", "struct")).groupBy("name").agg(F.min("sid").alias("sid"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select("name", "sid")
    lines = f.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    hit = lines.select("doc_id", "k", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("`([A-Za-z_]\\w{3,})`"), F.lit(1)))).alias("name")).join(known, "name")
    per = hit.groupBy("doc_id", "k").agg(F.array_sort(F.collect_set("sid")).alias("s")).where(F.size("s") > 1)
    # neighbours in sorted order: a line of many names gives as many edges, not all pairs
    return per.select(F.explode(F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n"))


def evaluation(ranked: DataFrame, expected: DataFrame, top: int = 4) -> DataFrame:
    """(n, recall, mrr): of questions with expected documents (qid, doc), the share that has one in the top and the mean inverse rank. ranked: (qid, doc, score)."""
    # the rank of the best expected document is one more than the number of documents before it: counted, not sorted, so no question is one task
    best = ranked.join(expected.distinct(), ["qid", "doc"]).groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc")).alias("b"))
    before = F.struct((-F.col("score")).alias("s"), "doc") < F.col("b")
    hit = ranked.join(best, "qid").groupBy("qid").agg((F.count_if(before) + 1).alias("rank"))
    q = expected.select("qid").distinct().join(hit, "qid", "left")
    return q.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.col("rank") <= top, F.lit(False)).cast("int")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
