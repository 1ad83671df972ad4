"""Questions that combine facts: what is unused, what reaches outside, which source lies inside its target, what fits a budget, how indexes compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.facts import Facts, USES
from factloom.functions.text import suffixes
from factloom.operators.graph import reach_each
from factloom.operators.hierarchy import descendants
from factloom.operators.more import first_parents
from factloom.operators.skew import top_n
from factloom.operators.tiers import opaque
from factloom.session import Scratch

#: The path of a test, and the kinds of references by which something counts as used.
TEST_PATH = r"(^|/)(tests?|testing)(/|$)|(^|/)test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$"
COUNTED = (*USES, "import", "variable_ref")


def is_test(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_PATH), F.lit(False))


def inside(f: Facts) -> DataFrame:
    """(sid, ancestor): each symbol with all that contain it, by links of parents; circles have none."""
    d = descendants(f.symbols.select(F.col("sid").alias("symbol_id"), F.col("pid").alias("parent_symbol_id")))
    return d.select(F.col("symbol_id").alias("sid"), F.col("ancestor_id").alias("ancestor"))


def unused_ranked(f: Facts, entries: DataFrame | None = None) -> DataFrame:
    """(sid, qname, path, confidence, reason) of functions, methods and classes that nothing outside them uses.

    Not asked of tests, entries (sid), dunders and functions called main. The first that holds decides: used by tests only, low; a decorator that is not
    transparent, low; a method of a class with bases, of a name that such classes share, low; the last name of an open reference, low; a leading
    underscore, high; else medium. References from inside the target are no use.
    """
    scratch = Scratch(f.spark, "unused")
    s = scratch.save(f.symbols.join(f.files.select("file_id", "path"), "file_id").select("sid", "pid", "qname", "name", "kind", "path", "base_classes", opaque(F.col("decorators")).alias("opaque"), is_test(F.col("path")).alias("test")))
    r = f.refs_of("src", "dst", "kind", "status", "tname")
    used = r.where(F.col("kind").isin(*COUNTED) & (F.col("status") == "resolved") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    used = used.join(s.select(F.col("sid").alias("src"), "test"), "src").join(inside(f).select(F.col("sid").alias("src"), F.col("ancestor").alias("dst")), ["src", "dst"], "left_anti")
    used = used.groupBy(F.col("dst").alias("sid")).agg(F.bool_and("test").alias("only_tests"))
    open_ = r.where(F.col("status").isin("unresolved", "ambiguous")).select(F.substring_index("tname", ".", -1).alias("name")).distinct().withColumn("open", F.lit(True))
    derived = s.where((F.col("kind") == "class") & (F.size("base_classes") > 0)).select(F.col("sid").alias("pid"), F.lit(True).alias("derives"))
    methods = s.where(F.col("kind") == "method").join(derived, "pid").select("sid", "name")
    c = s.where(F.col("kind").isin("function", "method", "class") & ~F.col("test") & ~F.col("name").rlike("^__.*__$") & ~((F.col("name") == "main") & (F.col("kind") == "function")))
    if entries is not None:
        c = c.join(entries, "sid", "left_anti")
    c = c.join(used, "sid", "left").where(F.col("only_tests").isNull() | F.col("only_tests")).join(methods.select("sid", F.lit(True).alias("inherits")), "sid", "left").join(open_, "name", "left")
    reason = (
        F.when(F.col("only_tests"), "only tests").when(F.col("opaque"), "decorated").when(F.col("inherits"), "may override").when(F.col("open"), "open call of that name").when(F.col("name").startswith("_"), "private").otherwise("public")
    )
    return c.select("sid", "qname", "path", F.when(reason == "private", "high").when(reason == "public", "medium").otherwise("low").alias("confidence"), reason.alias("reason"))


#: What external names are about and what they do, by prefixes at a dot. Other tables can be given.
CATEGORIES = {
    "os": "process", "os.Open": "filesystem", "os.path": "filesystem", "open": "filesystem", "printf": "logging", "fmt.Print": "logging", "fmt.Println": "logging", "fmt.Printf": "logging", "message": "logging",
    "subprocess": "process", "json": "persistence", "socket": "network", "requests": "network", "threading": "concurrency", "logging": "logging", "sqlite3": "database", "stdio.h": "filesystem", "stdlib.h": "process", "pthread.h": "concurrency",
}
OPERATIONS = {"os.Open": "io", "open": "io", "os.path.join": "pure", "printf": "output", "fmt.Print": "output", "fmt.Println": "output", "fmt.Printf": "output", "message": "output", "json.dumps": "pure", "json.loads": "pure", "json.load": "read", "json.dump": "write", "subprocess": "effect", "requests": "effect", "logging": "output"}
#: Operations that act on the world outside, and methods by whose name an open call is taken to read or write files.
EFFECTS = ("write", "effect", "output", "io")
WRITE_METHODS = ("write", "write_text", "write_bytes", "unlink", "mkdir", "rmdir", "rename", "touch")
READ_METHODS = ("read", "read_text", "read_bytes", "readlines", "exists", "is_file", "is_dir", "iterdir", "glob", "rglob")


def _longest(name: Column, table: dict[str, str]) -> Column:
    """The entry of a small table whose key is the longest prefix of a name at a dot: a chain of lookups in a map, no join."""
    m = F.create_map(*[F.lit(x) for p in sorted(table.items()) for x in p])
    parts = F.split(name, r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.try_element_at(m, F.array_join(F.slice(parts, 1, i), ".")))
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(heads, lambda x: x.isNotNull())), -1)


def externals(f: Facts, categories: dict[str, str] | None = None, operations: dict[str, str] | None = None) -> DataFrame:
    """(category, library, operation, source, path, line, kind, confidence): where the project meets the outside.

    External dependencies but Emacs Lisp's, of a known category or else as other if imports; external calls and names of a known category that are not
    pure; open dotted calls whose last name reads or writes files, inferred. Names of exceptions are pure.
    """
    categories, operations = categories or CATEGORIES, operations or OPERATIONS
    files = f.files.select("file_id", "path", "stated")
    d = f.deps.where((F.col("status") == "external") & (F.length("tname") > 0)).join(files, "file_id").where(~F.coalesce(F.col("stated") == "elisp", F.lit(False)))
    d = d.withColumn("category", F.coalesce(_longest(F.col("tname"), categories), F.when(F.col("kind") == "import", "other"))).where(F.col("category").isNotNull())
    d = d.select("category", F.col("tname").alias("library"), F.lit("import").alias("operation"), F.lit(None).cast("string").alias("source"), "path", F.col("start_line").alias("line"), F.col("kind").alias("kind"), F.lit("confirmed").alias("confidence"))
    r = f.refs_of("file_id", "src", "tname", "kind", "start_line", "status").where(F.length("tname") > 0).join(files, "file_id")
    exception = F.substring_index("tname", ".", -1).rlike("^[A-Z].*(Error|Exception|Warning|Exit|Interrupt)$")
    e = r.where((F.col("status") == "external") & F.col("kind").isin("call", "name_ref")).withColumn("category", _longest(F.col("tname"), categories)).where(F.col("category").isNotNull())
    e = e.withColumn("operation", F.when(exception, "pure").otherwise(F.coalesce(_longest(F.col("tname"), operations), F.lit("call")))).where(F.col("operation") != "pure")
    e = e.select("category", F.col("tname").alias("library"), "operation", F.col("src").alias("source"), "path", F.col("start_line").alias("line"), F.lit("call").alias("kind"), F.lit("confirmed").alias("confidence"))
    last = F.substring_index("tname", ".", -1)
    o = r.where((F.col("status") == "unresolved") & (F.col("kind") == "call") & F.contains("tname", F.lit(".")) & last.isin(*WRITE_METHODS, *READ_METHODS))
    o = o.select(F.lit("filesystem").alias("category"), F.col("tname").alias("library"), F.when(last.isin(*WRITE_METHODS), "write").otherwise("read").alias("operation"), F.col("src").alias("source"), "path", F.col("start_line").alias("line"), F.lit("call").alias("kind"), F.lit("inferred").alias("confidence"))
    return d.unionByName(e).unionByName(o)


def effects(f: Facts, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node, distance, parent, operation, n): operations on the outside, reads too, of what the seeds (node) call within ``depth`` calls, with the caller on a shortest way."""
    reached = first_parents(f.calls().select("src", "dst").distinct(), seeds, depth)
    uses = externals(f).where((F.col("kind") == "call") & F.col("operation").isin(*EFFECTS, "read")).groupBy(F.col("source").alias("node"), "operation").agg(F.count(F.lit(1)).alias("n"))
    return reached.join(uses, "node").select("node", "distance", "parent", "operation", "n")


# -- what fits ------------------------------------------------------------------------------------------------------------


def within_budget(items: DataFrame, group: list[str], order: list[Column], size: str, budget: int, salt: str) -> DataFrame:
    """The first items of each group whose sizes add up to at most ``budget``, with their running total.

    Sizes count as 1 at least, so only the first ``budget`` items of a group can fit: these are found in parts before one window adds them up.
    """
    w = F.greatest(F.coalesce(size, F.lit(1)), F.lit(1))
    first = top_n(items.withColumn("_size", w), group, order, budget, salt)
    run = F.sum("_size").over(Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("total", run).where(F.col("total") <= budget).drop("_size")


def first_matches(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in order, and whether there are more: (.., more). One heap per task, no full sort."""
    got = rows.orderBy(*order).limit(limit + 1).withColumn("_k", F.row_number().over(Window.orderBy(*order)))  # at most limit + 1 rows
    return got.withColumn("more", F.max("_k").over(Window.partitionBy()) > limit).where(F.col("_k") <= limit).drop("_k")


# -- other tools' views ---------------------------------------------------------------------------------------------------


def match_binary_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file_id): source names in debugging information whose path is the tail of exactly one project file. names: (name); files: (file_id, path)."""
    parts = F.split("path", "/")
    tails = files.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    one = tails.groupBy("tail").agg(F.min("file_id").alias("file_id"), F.count_distinct("file_id").alias("n")).where(F.col("n") == 1).select("tail", "file_id")
    return names.select("name", F.regexp_replace(F.regexp_replace("name", r"\\", "/"), r"^[./]+", "").alias("tail")).distinct().join(one, "tail").select("name", "file_id")


def match_binary_symbols(functions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, state, sid, n): functions of a binary (name, candidates, file) against symbols (sid, name, path): matched, ambiguous or binary_only.

    The first candidate name that any symbol has counts. The function's file narrows several; a single one in another file is no match.
    """
    c = functions.select("name", F.regexp_replace(F.regexp_replace(F.coalesce("file", F.lit("")), r"\\", "/"), r"^[./]+", "").alias("tail"), F.posexplode("candidates").alias("pos", "candidate"))
    hit = c.join(symbols.select(F.col("name").alias("candidate"), "sid", "path"), "candidate")
    best = hit.groupBy("name").agg(F.min("pos").alias("pos"))
    hit = hit.join(best, ["name", "pos"]).withColumn("fits", (F.col("path") == F.col("tail")) | F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("tail"))))
    fit = F.col("fits") & (F.length("tail") > 0)
    per = hit.groupBy("name").agg(F.count_distinct("sid").alias("n"), F.count_distinct(F.when(fit, F.col("sid"))).alias("n_fit"), F.min("sid").alias("any"), F.min(F.when(fit, F.col("sid"))).alias("fit"), F.max(F.length("tail")).alias("t"))
    n = F.when((F.col("t") > 0) & (F.col("n_fit") > 0), F.col("n_fit")).when((F.col("t") > 0) & (F.col("n") == 1), 0).otherwise(F.col("n"))
    per = per.select("name", n.alias("n"), F.when(F.col("n_fit") == 1, F.col("fit")).otherwise(F.col("any")).alias("sid"))
    j = functions.select("name").distinct().join(per, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("name", F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("binary_only").alias("state"), F.when(F.col("n") == 1, F.col("sid")).alias("sid"), "n")


def binary_functions(matched: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, state): the functions of a binary by state, and as source_only those symbols (sid, name, file_id) of files with a match that none matches."""
    hit = matched.where(F.col("state") == "matched").select("sid")
    seen = symbols.join(hit, "sid", "left_semi").select("file_id").distinct()
    rest = symbols.join(seen, "file_id", "left_semi").join(hit, "sid", "left_anti").select("name", F.lit("source_only").alias("state"))
    return matched.select("name", "state").unionByName(rest)


def compare_edges(static: DataFrame, other: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(src, dst, state): both, other_only or static_only of edges between ``ends`` (node) if given; static_only only of sources with an edge in ``other``."""
    a, b = static.select("src", "dst").distinct(), other.select("src", "dst").distinct()
    if ends is not None:
        for side in ("src", "dst"):
            a, b = (x.join(ends.select(F.col("node").alias(side)).distinct(), side, "left_semi") for x in (a, b))
    both = a.join(b, ["src", "dst"], "left_semi").withColumn("state", F.lit("both"))
    new = b.join(a, ["src", "dst"], "left_anti").withColumn("state", F.lit("other_only"))
    old = a.join(b, ["src", "dst"], "left_anti").join(b.select("src").distinct(), "src", "left_semi").withColumn("state", F.lit("static_only"))
    return both.unionByName(new).unionByName(old)


def compare_index(refs: DataFrame, occurrences: DataFrame, definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(reference_id, state, own): references against an index of occurrences: no_occurrence, confirmed, conflict, index_resolves or external.

    refs: (reference_id, path, line, name, dst, own), own the resolver's state; occurrences: (path, line, name, symbol) without definitions; definitions:
    (symbol, path, line); symbols: (sid, path, start_line, end_line). The last part of a dotted name counts. Confirmed: one of the index's
    definitions lies within the own target; with an own target it is else a conflict.
    """
    r = refs.withColumn("last", F.substring_index("name", ".", -1))
    hit = r.join(occurrences.select("path", "line", F.col("name").alias("last"), "symbol").distinct(), ["path", "line", "last"]).select("reference_id", "symbol", "dst").distinct()
    place = hit.join(definitions.select("symbol", F.col("path").alias("at"), F.col("line").alias("in_line")), "symbol", "left").join(symbols.select(F.col("sid").alias("dst"), F.col("path").alias("tpath"), "start_line", "end_line"), "dst", "left")
    within = (F.col("at") == F.col("tpath")) & F.col("in_line").between(F.col("start_line"), F.col("end_line"))
    per = place.groupBy("reference_id").agg(F.bool_or(F.coalesce(within, F.lit(False))).alias("within"), F.bool_or(F.col("at").isNotNull()).alias("placed"), F.bool_or(F.col("tpath").isNotNull()).alias("targeted"))
    state = F.when(F.col("placed").isNull(), "no_occurrence").when((F.col("own") == "resolved") & F.col("targeted"), F.when(F.col("within"), "confirmed").otherwise("conflict")).when(F.col("placed"), "index_resolves").otherwise("external")
    return r.join(per, "reference_id", "left").select("reference_id", state.alias("state"), "own")


def index_states(compared: DataFrame) -> DataFrame:
    """(own, state, n) of a comparison."""
    return compared.groupBy("own", "state").agg(F.count(F.lit(1)).alias("n"))


def overlay(static: DataFrame, observed: DataFrame, inferred: DataFrame) -> DataFrame:
    """(src, dst, style, n): static edges (src, dst, style) with observed counts (src, dst, n); edges seen only as observed, and inferred ones (src, dst) apart, as ai."""
    o = observed.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    s = static.select("src", "dst", "style").distinct()
    seen = s.join(o, ["src", "dst"], "left").select("src", "dst", "style", F.coalesce("n", F.lit(0)).alias("n"))
    only = o.join(s.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit("observed").alias("style"), "n")
    return seen.unionByName(only).unionByName(inferred.select("src", "dst").distinct().select("src", "dst", F.lit("ai").alias("style"), F.lit(0).cast("long").alias("n")))


# -- evaluation and explanations --------------------------------------------------------------------------------------------


def evaluate(runs: DataFrame) -> DataFrame:
    """(n, pass_rate, citation_validity, recall) of runs (status, passed, valid, cited, recall): ratio of sums for citations, recall without nulls."""
    return runs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("int")).alias("pass_rate"), (F.sum("valid") / F.nullif(F.sum("cited"), F.lit(0))).alias("citation_validity"), F.avg("recall").alias("recall"))


def score_answers(cited: DataFrame, expected: DataFrame, answers: DataFrame, words: DataFrame) -> DataFrame:
    """(case, evidence, terms, forbidden, passed): shares of expected spans that a citation overlaps and of expected words in the answer, and forbidden words in it.

    cited, expected: (case, path, start, end); answers: (case, text); words: (case, word, forbidden). Passed: all evidence and words, nothing forbidden.
    """
    spans = expected.distinct().join(cited.select("case", "path", F.col("start").alias("a"), F.col("end").alias("b")), ["case", "path"], "left")
    hit = spans.groupBy("case", "path", "start", "end").agg(F.bool_or(F.coalesce((F.col("a") <= F.col("end")) & (F.col("b") >= F.col("start")), F.lit(False))).alias("hit"))
    ev = hit.groupBy("case").agg(F.avg(F.col("hit").cast("int")).alias("evidence"))
    w = words.distinct().join(answers, "case").withColumn("has", F.contains(F.lower("text"), F.lower("word")))
    tm = w.groupBy("case").agg(F.avg(F.when(~F.col("forbidden"), F.col("has").cast("int"))).alias("terms"), F.count_if(F.col("forbidden") & F.col("has")).alias("forbidden"))
    out = answers.select("case").distinct().join(ev, "case", "left").join(tm, "case", "left").withColumn("forbidden", F.coalesce("forbidden", F.lit(0)))
    ok = (F.coalesce("evidence", F.lit(1.0)) == 1) & (F.coalesce("terms", F.lit(1.0)) == 1) & (F.col("forbidden") == 0)
    return out.select("case", "evidence", "terms", "forbidden", ok.alias("passed"))


def stale_explanations(explanations: DataFrame, hashes: DataFrame) -> DataFrame:
    """(explanation_id, path): sources whose hash is no longer the one an explanation was made from. explanations: (explanation_id, sources map<path, hash>); hashes: (path, hash)."""
    e = explanations.select("explanation_id", F.explode("sources").alias("path", "was"))
    return e.join(hashes, "path", "left").where(~F.col("was").eqNullSafe(F.col("hash"))).select("explanation_id", "path")


def caught_by(exceptions: DataFrame, calls: DataFrame) -> DataFrame:
    """(exception, origin, n_sites, n_catching): call sites of each function that raises, and those where a guard around catches what it raises.

    exceptions: (qname, what, name, line, end_line, caught); calls: (source, target, line).
    """
    raised = exceptions.where((F.col("what") == "raise") & ~F.col("caught")).select(F.col("qname").alias("target"), F.col("name").alias("exception")).distinct()
    sites = calls.select("source", "target", F.col("line").alias("at")).distinct().join(raised, "target")
    guard = exceptions.where(F.col("what") == "guard").select(F.col("qname").alias("source"), F.col("name").alias("catches"), F.col("line").alias("a"), F.col("end_line").alias("b"))
    around = (F.col("at") > F.col("a")) & (F.col("at") <= F.col("b")) & ((F.col("catches") == F.col("exception")) | F.col("catches").isin("*", "Exception", "BaseException"))
    per = sites.join(guard, "source", "left").groupBy("source", "target", "at", "exception").agg(F.bool_or(F.coalesce(around, F.lit(False))).alias("caught"))
    return per.groupBy("exception", F.col("target").alias("origin")).agg(F.count(F.lit(1)).alias("n_sites"), F.count_if("caught").alias("n_catching"))


def exit_reach(exits: DataFrame, calls: DataFrame, depth: int = 5) -> DataFrame:
    """(qname, kind, origin, distance): the least number of calls from each function to one that ends the program, jumps or throws, for each kind and origin.

    exits: (qname, kind); calls: (source, target) of resolved calls. Layers of callers are added until none is new or ``depth`` is reached.
    """
    scratch = Scratch(exits.sparkSession, "exits")
    up = scratch.save(calls.where(F.col("source") != F.col("target")).select("source", F.col("target").alias("qname")).distinct())
    layer = out = scratch.save(exits.select("qname", "kind", F.col("qname").alias("origin")).distinct().withColumn("distance", F.lit(0)))
    for k in range(1, depth + 1):
        step = layer.join(up, "qname").select(F.col("source").alias("qname"), "kind", "origin").distinct()
        layer, n = scratch.save_counted(step.join(out.select("qname", "kind", "origin"), ["qname", "kind", "origin"], "left_anti").withColumn("distance", F.lit(k)))
        out = out.unionByName(layer)
        if not n:
            break
    return out


def config_uses(findings: DataFrame, variables: DataFrame) -> DataFrame:
    """(file_id, qname, item, name, line): where variables are used that hold a setting: those defined on the line that reads it, in the same function."""
    read = findings.where(F.col("rule").isin("env-read", "cli-option")).select("file_id", "qname", "line", F.col("detail").alias("item"))
    made = variables.where((F.col("what") == "def") & F.col("how").isin("assign", "let", "walrus")).select("file_id", "qname", "line", "name")
    use = variables.where(F.col("what") == "use").select("file_id", "qname", "name", F.col("line").alias("at"))
    return read.join(made, ["file_id", "qname", "line"]).join(use, ["file_id", "qname", "name"]).where(F.col("at") > F.col("line")).select("file_id", "qname", "item", "name", F.col("at").alias("line")).distinct()


def known_calls(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """(file_id, source, target, line) of calls (file_id, source, kind, target, line) whose name, or its end, belongs to one of the functions (qname) only."""
    q = functions.select("qname").distinct()
    keys = q.select("qname", F.explode(F.array_union(F.array("qname"), suffixes(F.col("qname")))).alias("callee"))
    one = keys.groupBy("callee").agg(F.min("qname").alias("q"), F.count_distinct("qname").alias("n")).where(F.col("n") == 1)
    return refs.where(F.col("kind") == "call").join(one.select(F.col("callee").alias("target"), "q"), "target").select("file_id", "source", F.col("q").alias("target"), "line")


def understand(f: Facts, seeds: DataFrame) -> DataFrame:
    """(node, question, item, n): a card for each seed (node): callers, callees, open calls, outside operations, tests that reach it within 3, symbols it affects within 4."""
    calls = f.calls("file_id").select("src", "dst").distinct()
    uses = f.uses()
    r = f.refs_of("src", "kind", "status", "tname").where((F.col("kind") == "call") & F.col("status").isin("unresolved", "ambiguous"))
    row = lambda df, q, item, n: df.select("node", F.lit(q).alias("question"), item.alias("item"), n.alias("n"))
    one = F.lit(1).cast("long")
    out = row(calls.join(seeds.select(F.col("node").alias("dst"), "node"), "dst"), "caller", F.col("src"), one)
    out = out.unionByName(row(calls.join(seeds.select(F.col("node").alias("src"), "node"), "src"), "callee", F.col("dst"), one))
    out = out.unionByName(r.join(seeds.select(F.col("node").alias("src"), "node"), "src").groupBy("node", F.lit("open").alias("question"), F.coalesce("tname", F.lit("")).alias("item")).agg(F.count(F.lit(1)).alias("n")))
    ops = externals(f).where(F.col("kind") == "call").join(seeds.select(F.col("node").alias("source"), "node"), "source")
    out = out.unionByName(ops.groupBy("node", F.lit("outside").alias("question"), F.col("operation").alias("item")).agg(F.count(F.lit(1)).alias("n")))
    tests = f.symbols.join(f.files.where(is_test(F.col("path"))).select("file_id"), "file_id", "left_semi").select("sid")
    near = reach_each(uses, seeds, 4, reverse=True).where(F.col("distance") > 0)
    out = out.unionByName(row(near.where(F.col("distance") <= 3).select(F.col("origin").alias("node"), F.col("node").alias("sid"), "distance").join(tests, "sid", "left_semi"), "test", F.col("sid"), F.col("distance").cast("long")))
    return out.unionByName(near.groupBy(F.col("origin").alias("node")).agg(F.count(F.lit(1)).alias("n")).select("node", F.lit("impact").alias("question"), F.lit("symbols").alias("item"), "n"))
