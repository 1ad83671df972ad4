"""Filters, joins, aggregations, windows and set operations on facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.facts import Facts
from factloom.functions.text import suffixes
from factloom.operators.skew import away_from_null, balanced_left_join, top_n
from factloom.session import Scratch

CALLABLE = ("function", "method")
#: Kinds of variables.
VARIABLES = ("local_variable", "class_variable", "global_variable")


# -- filters ----------------------------------------------------------------------------------------------------------


def match_symbols(f: Facts, query: str, how: str) -> DataFrame:
    """Symbols by name. exact: case-sensitive on name or qualified name; prefix: any case, either; substring: any case, qualified name."""
    s, low = f.symbols, query.lower()
    if how == "exact":
        hit = (F.col("name") == query) | (F.col("qname") == query)
    elif how == "prefix":
        hit = F.lower("name").startswith(low) | F.lower("qname").startswith(low)
    elif how == "substring":
        hit = F.contains(F.lower("qname"), F.lit(low))
    else:
        raise ValueError(how)
    return s.where(hit).join(f.files.select("file_id", "path"), "file_id").select("sid", "qname", "kind", "path", "start_line")


def lookup(f: Facts, name: str) -> DataFrame:
    """Definition lookup: the best tier of exact qualified name, exact name, qualified-name suffix; local variables only if nothing else is left."""
    tier = F.when(F.col("qname") == name, 0).when(F.col("name") == name, 1).when(F.exists(suffixes(F.col("qname")), lambda x: x == name), 2)
    s = f.symbols.withColumn("tier", tier).where(F.col("tier").isNotNull())
    local = F.col("kind") == "local_variable"
    best = s.agg(F.min("tier").alias("t")).scalar()
    s = s.where(F.col("tier") == best)
    others = s.where(~local).agg(F.count(F.lit(1)).alias("n")).scalar()
    return s.where(~local | (others == 0)).select("sid", "qname", "kind", "tier")


def grep(f: Facts, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(file_id, path, line, text): lines of files in the analysed languages that match a regular expression. Files without a match never reach the explosion."""
    pattern = ("(?i)" if ignore_case else "") + pattern
    files = f.files.where(F.col("stated").isNotNull()).select("file_id", "path")
    t = f.raw("source_texts").where(F.col("content").rlike(pattern)).select("file_id", "content")
    lines = files.join(t, "file_id").select("file_id", "path", F.posexplode(F.split("content", "\r\n|\n")).alias("at", "text"))
    return lines.where(F.col("text").rlike(pattern)).select("file_id", "path", (F.col("at") + 1).alias("line"), "text")


def glob_regex(glob: str) -> str:
    """A shell glob as a regular expression for whole strings; * crosses directories."""
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in "\\.[]{}()+^$|" else c for c in glob)
    return f"^{out}$"


def without(f: Facts, globs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, symbols, refs) without the files that match a glob. References with a null target stay, those to dropped symbols go."""
    drop = F.lit(False)
    for g in globs:
        drop = drop | F.col("path").rlike(glob_regex(g))
    files = f.files.where(~drop)
    kept = files.select("file_id")
    symbols = f.symbols.join(kept, "file_id", "left_semi")
    gone = f.symbols.select(F.col("sid").alias("dst"), "file_id").join(kept, "file_id", "left_anti").select("dst")
    refs = f.refs.join(kept, "file_id", "left_semi").withColumn("_dst", away_from_null("dst", "reference_id"))
    return files, symbols, refs.join(gone.withColumnRenamed("dst", "_dst"), "_dst", "left_anti").drop("_dst")


def test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests?|testing|spec)/|(^|/)test_[^/]*$|_test\.[a-z]+$|(^|/)conftest\.py$")


def unresolved(f: Facts) -> DataFrame:
    """(note, status, n): unresolved and ambiguous references by reason."""
    r = f.refs_of("status", "note").where(F.col("status").isin("unresolved", "ambiguous"))
    return r.groupBy("note", "status").agg(F.count_distinct("reference_id").alias("n"))


def inbox(f: Facts, sample: int = 30) -> DataFrame:
    """(sid, qname, n_unresolved, n_ambiguous, first_targets): open calls per function, with the first target names by line."""
    r = f.refs_of("src", "kind", "status", "tname", "start_line").where((F.col("kind") == "call") & F.col("status").isin("unresolved", "ambiguous"))
    per = r.groupBy(F.col("src").alias("sid")).agg(F.count_if(F.col("status") == "unresolved").alias("n_unresolved"), F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous"))
    first = top_n(r, ["src"], [F.asc("start_line"), F.asc("tname"), F.asc("reference_id")], sample, "reference_id")
    shown = F.struct("rank", F.concat_ws(":", F.col("start_line"), F.coalesce("tname", F.lit(""))).alias("t"))
    first = first.groupBy(F.col("src").alias("sid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]), ", ").alias("first_targets"))
    per = per.join(first, "sid")
    return per.join(f.symbols.select("sid", "qname"), "sid")


# -- joins ------------------------------------------------------------------------------------------------------------


def ref_hits(f: Facts) -> DataFrame:
    """References with the source's and target's qualified names and the file's path; the target may be unknown."""
    src = f.symbols.select(F.col("sid").alias("src"), F.col("qname").alias("source"))
    dst = f.symbols.select(F.col("sid").alias("dst"), F.col("qname").alias("target"))
    rows = f.refs.join(src, "src").join(f.files.select("file_id", "path"), "file_id")
    return balanced_left_join(rows, dst, "dst", "reference_id", Scratch(f.spark, "hits")).select("reference_id", "source", "target", "tname", "kind", "path", "start_line", "status")


def dep_hits(f: Facts) -> DataFrame:
    s = f.files.select("file_id", F.col("path").alias("source_path"))
    t = f.files.select(F.col("file_id").alias("target_file_id"), F.col("path").alias("target_path"))
    return f.deps.join(s, "file_id").join(t, "target_file_id", "left").select("dependency_id", "source_path", "target_path", "tname", "kind", "status")


def same_usr(symbols: DataFrame) -> DataFrame:
    """(sid, twin): a symbol stands for all with the same non-null usr and for itself. Pairs within one usr link to its least symbol, both ways,
    so a usr that very many rows share gives two rows per symbol, not all pairs."""
    u = symbols.where(F.length("usr") > 0)
    head = u.groupBy("usr").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    linked = u.join(head, "usr").where(F.col("sid") != F.col("head")).select("sid", "head")
    twins = linked.select("sid", F.col("head").alias("twin")).union(linked.select(F.col("head").alias("sid"), F.col("sid").alias("twin")))
    return symbols.select("sid", F.col("sid").alias("twin")).union(twins)


def innermost_owner(f: Facts) -> DataFrame:
    """(reference_id, owner): the smallest function, method or class around each reference's line, else the file's module.

    A containment join on file and blocks of lines: each symbol is listed under the blocks of 64 lines that it spans and
    each reference looks in its own block only, so a long file is no hot pair of lists.
    """
    block = 64
    r = f.refs_of("file_id", "start_line").withColumn("block", F.floor(F.col("start_line") / block))
    s = f.symbols.where(F.col("kind").isin("function", "method", "class", "struct") & (F.col("start_line") <= F.col("end_line")))
    s = s.select("file_id", "sid", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    s = s.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))))
    inner = r.join(s, ["file_id", "block"]).where(F.col("start_line").between(F.col("a"), F.col("b")))
    best = inner.groupBy("reference_id").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("size"), "sid")).alias("m")).select("reference_id", F.col("m.sid").alias("inner"))
    module = f.symbols.where(F.col("kind") == "module").groupBy("file_id").agg(F.min("sid").alias("module"))
    return r.join(best, "reference_id", "left").join(module, "file_id", "left").select("reference_id", F.coalesce("inner", "module").alias("owner"))


def suffix_matches(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, n_exact, n_suffix, unique_sid): candidates for dotted names (name) by exact qualified name, else by any suffix.

    The suffixes of qualified names are exploded, so that "ends in" becomes an equi-join. A match counts only where it is the single one.
    """
    s = symbols.select("sid", "qname")
    exact = s.select(F.col("qname").alias("name"), "sid", F.lit(0).alias("tier"))
    tails = s.select(F.explode(suffixes(F.col("qname"))).alias("name"), "sid").withColumn("tier", F.lit(1))
    hits = names.select("name").distinct().join(exact.union(tails), "name")
    per = hits.groupBy("name").agg(
        F.count_if(F.col("tier") == 0).alias("n_exact"), F.count_if(F.col("tier") == 1).alias("n_suffix"), F.min(F.when(F.col("tier") == 0, F.col("sid"))).alias("e"), F.min(F.when(F.col("tier") == 1, F.col("sid"))).alias("s")
    )
    one = F.when(F.col("n_exact") == 1, F.col("e")).when((F.col("n_exact") == 0) & (F.col("n_suffix") == 1), F.col("s"))
    return per.select("name", "n_exact", "n_suffix", one.alias("unique_sid"))


def longest_prefix(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, prefix, category): the entry of ``dictionary`` (prefix, category) that is the longest prefix of each name at a dot."""
    parts = F.split("name", r"\.")
    heads = names.distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))))
    return heads.join(dictionary, "prefix").groupBy("name").agg(F.max_by(F.struct("prefix", "category"), F.length("prefix")).alias("m")).select("name", "m.*")


# -- aggregations -----------------------------------------------------------------------------------------------------


def fan(f: Facts) -> DataFrame:
    """(file_id, fan_in, fan_out): distinct files that depend on a file, and that it depends on."""
    e = f.file_edges()
    out = e.groupBy(F.col("src").alias("file_id")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("file_id")).agg(F.count(F.lit(1)).alias("fan_in"))
    zero = F.lit(0).cast("long")
    return f.files.select("file_id").join(into, "file_id", "left").join(out, "file_id", "left").select("file_id", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def modules(f: Facts) -> DataFrame:
    per = f.symbols.groupBy("file_id").agg(F.count_if(F.col("kind").isin("function", "method", "class", "struct", "macro")).alias("definitions"), F.max("end_line").alias("lines"))
    return f.files.select("file_id", "path").join(per, "file_id", "left").join(fan(f), "file_id").select("file_id", "path", F.coalesce("definitions", F.lit(0).cast("long")).alias("definitions"), F.coalesce("lines", F.lit(0)).alias("lines"), "fan_in", "fan_out")


def most_called(f: Facts, top: int | None = 20) -> DataFrame:
    """(sid, qname, n): symbols by the number of distinct callers, self calls aside. Distinct pairs first, so no target is hot."""
    pairs = f.calls().select("src", "dst").distinct()
    n = pairs.groupBy(F.col("dst").alias("sid")).agg(F.count(F.lit(1)).alias("n"))
    named = n.join(f.symbols.select("sid", "qname"), "sid")
    return named.orderBy(F.desc("n"), "qname", "sid").limit(top) if top else named


def most_calling(f: Facts, top: int | None = 20) -> DataFrame:
    pairs = f.calls().select("src", "dst").distinct()
    n = pairs.groupBy(F.col("src").alias("sid")).agg(F.count(F.lit(1)).alias("n"))
    named = n.join(f.symbols.select("sid", "qname"), "sid")
    return named.orderBy(F.desc("n"), "qname", "sid").limit(top) if top else named


def merged_edges(f: Facts) -> DataFrame:
    """(src, dst, kind, style, n, first_line, notes): references merged to edges; notes joined in order."""
    style = F.when(F.col("status") == "external", "external").when(F.col("status") != "resolved", "unresolved").when(F.col("confidence") == "inferred", "inferred").otherwise("confirmed")
    r = f.refs.where(F.col("dst").isNotNull()).withColumn("style", style)
    note = F.when(F.length("note") > 0, F.col("note"))
    return r.groupBy("src", "dst", "kind", "style").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first_line"), F.array_join(F.array_sort(F.collect_set(note)), " / ").alias("notes"))


def component_of(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a path, or (root)."""
    parts = F.split(path, "/")
    n = F.least(F.lit(depth), F.size(parts) - 1)
    return F.when(n <= 0, F.lit("(root)")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/"))


def component_edges(f: Facts, depth: int = 2) -> DataFrame:
    """(source, target, n): resolved dependencies between components of directories within one project."""
    c = f.files.select("file_id", "project_id", component_of(F.col("path"), depth).alias("component"))
    a = c.select(F.col("file_id").alias("src"), F.col("project_id").alias("p1"), F.col("component").alias("source"))
    b = c.select(F.col("file_id").alias("dst"), F.col("component").alias("target"))
    e = f.file_edges().join(a, "src").join(b, "dst").where(F.col("source") != F.col("target"))
    return e.groupBy(F.col("p1").alias("project_id"), "source", "target").agg(F.count(F.lit(1)).alias("n"))


def churn(commits: DataFrame) -> DataFrame:
    """(path, n_commits, n_authors, first, last) of (commit, author, day, path)."""
    return commits.groupBy("path").agg(F.count_distinct("commit").alias("n_commits"), F.count_distinct("author").alias("n_authors"), F.min("day").alias("first"), F.max("day").alias("last"))


def coupling(commits: DataFrame, least: int = 2, most: int = 30, support: int = 3) -> DataFrame:
    """(a, b, n): paths changed together in at least ``support`` commits that touch ``least`` to ``most`` paths.

    Larger commits say nothing about coupling; leaving them out also bounds the pairs of a commit.
    """
    c = commits.select("commit", "path").distinct()
    size = c.groupBy("commit").agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(least, most)).select("commit")
    c = c.join(size, "commit")
    per = c.groupBy("commit").agg(F.array_sort(F.collect_set("path")).alias("p"))
    pair = per.select(F.explode(F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, most), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x"))
    return pair.groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)


def described(f: Facts) -> DataFrame:
    """(sid, qname, n_members, n_callers, n_callees, n_incoming, n_files): one row per symbol."""
    members = f.symbols.where(F.col("pid").isNotNull()).groupBy(F.col("pid").alias("sid")).agg(F.count(F.lit(1)).alias("n_members"))
    calls = f.calls().select("src", "dst").distinct()
    callers = calls.groupBy(F.col("dst").alias("sid")).agg(F.count(F.lit(1)).alias("n_callers"))
    callees = calls.groupBy(F.col("src").alias("sid")).agg(F.count(F.lit(1)).alias("n_callees"))
    into = f.refs_of("file_id", "dst", "status").where((F.col("status") == "resolved") & F.col("dst").isNotNull())
    into = into.groupBy(F.col("dst").alias("sid")).agg(F.count_distinct("reference_id").alias("n_incoming"), F.count_distinct("file_id").alias("n_files"))
    out = f.symbols.select("sid", "qname")
    for part in (members, callers, callees, into):
        out = out.join(part, "sid", "left")
    return out.na.fill(0, ["n_members", "n_callers", "n_callees", "n_incoming", "n_files"])


# -- windows ----------------------------------------------------------------------------------------------------------


def ordinals(f: Facts) -> DataFrame:
    """(sid, ordinal): the how-manieth symbol of the same kind and qualified name in its file; keeps ids stable when lines move."""
    w = Window.partitionBy("file_id", "kind", "qname").orderBy("start_line", "end_line", "sid")
    return f.symbols.select("sid", (F.row_number().over(w) - 1).alias("ordinal"))


def top_per_group(f: Facts, n: int = 3) -> DataFrame:
    """(kind, rank, sid, span): the longest symbols of each kind."""
    s = f.symbols.select("sid", "kind", (F.col("end_line") - F.col("start_line") + 1).alias("span"))
    return top_n(s, ["kind"], [F.desc("span"), F.asc("sid")], n, "sid").select("kind", "rank", "sid", "span")


def references_in_order(f: Facts) -> DataFrame:
    """All references by file, line, name and id. Null names come first, other nulls last."""
    last = [F.col(c).asc_nulls_last() for c in ("file_id", "start_line", "reference_id")]
    return f.refs_of("file_id", "start_line", "tname").orderBy(last[0], last[1], F.col("tname").asc_nulls_first(), last[2])


# -- sets -------------------------------------------------------------------------------------------------------------


def hash_changes(f: Facts) -> DataFrame:
    """(file_id, state): changed, unchanged, removed or added between the oldest and the latest scan of each file and the current texts."""
    first = f.raw("source_files").where(F.col("file_id").isNotNull() & F.col("content_hash").isNotNull()).groupBy("file_id").agg(F.min(F.struct(F.coalesce("last_analyzed_at", F.lit("1900-01-01").cast("timestamp_ntz")).alias("at"), "content_hash")).alias("m"))
    old = first.select("file_id", F.col("m.content_hash").alias("old"))
    new = f.raw("source_texts").where(F.col("content").isNotNull()).select("file_id", F.sha2("content", 256).alias("new")).distinct()
    state = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "file_id", "full_outer").select("file_id", state.alias("state"))


def freshness(f: Facts) -> DataFrame:
    """(file_id, state): fresh, stale, missing or unanalyzed, by the hash of the current text."""
    now = f.raw("source_texts").groupBy("file_id").agg(F.max(F.sha2("content", 256)).alias("now"))
    state = F.when(F.col("content_hash").isNull(), "unanalyzed").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("content_hash"), "fresh").otherwise("stale")
    return f.files.join(now, "file_id", "left").select("file_id", state.alias("state"))


def unused(f: Facts) -> DataFrame:
    """(sid, qname, verdict): functions, methods and classes that nothing else refers to.

    Not asked of dunders, main and tests. used: a resolved reference from another symbol; maybe: an unresolved reference of the same
    last name; decorated: a decorator may call it; else unused. Used ones are left out.
    """
    s = f.symbols.join(f.files.select("file_id", "path"), "file_id").where(F.col("kind").isin("function", "method", "class") & ~test_path(F.col("path")))
    s = s.where(~F.col("name").rlike("^__.*__$") & ~F.coalesce(F.col("name") == "main", F.lit(False)))
    r = f.refs_of("src", "dst", "status", "tname")
    used = r.where((F.col("status") == "resolved") & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("sid")).distinct()
    last = F.regexp_extract("tname", r"([^.:/>\-]+)$", 1)
    open_ = r.where(F.col("status").isin("unresolved", "ambiguous")).select(last.alias("name")).where(F.length("name") > 0).distinct().withColumn("maybe", F.lit(True))
    left = s.join(used, "sid", "left_anti").join(open_, "name", "left")
    verdict = F.when(F.col("maybe"), "maybe").when(F.size("decorators") > 0, "decorated").otherwise("unused")
    return left.select("sid", "qname", verdict.alias("verdict"))
