"""Queries of composite questions and of analyses of functions in all languages, with equivalent SQL where SQL can read what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.facts import Facts
from factloom.functions.text import identifier_words
from factloom.operators import functions, graph, more, questions as qs, relational as rel
from factloom.operators.skew import top_n
from factloom.plans.reference import ORACLE, _CALLS, _COMP, _DEP, _FE, _FILES, _FRESH, _LINES, _NEAREST, _NORM, _REF, _ROLES, _SEED_S, _SEED_SRC, _STOP, _SYM, _USES, _code, _reach, _seed_symbols, _violations, add

# -- filters and sets -----------------------------------------------------------------------------------------------------

_TEST = r"coalesce(regexp_matches(path, '(^|/)(tests?|testing)(/|$)|(^|/)test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$'), false)"
add("f_is_test", lambda f: f.files.select("file_id", qs.is_test(F.col("path")).alias("is_test")), f"SELECT file_id, {_TEST} AS is_test FROM files", _FILES)
add("f_hide_slot", lambda f: f.refs_of("kind").where(F.coalesce(F.col("kind") != "slot_source", F.lit(True))).groupBy("kind").agg(F.count_distinct("reference_id").alias("n")), "SELECT kind, count(DISTINCT reference_id) AS n FROM rf WHERE kind IS DISTINCT FROM 'slot_source' GROUP BY kind", _REF)


def _visible(f: Facts) -> DataFrame:
    """Files that neither a directory nor a file pattern of their project excludes."""
    p = f.raw("projects").groupBy("project_id").agg(F.max("exclude_dirs").alias("dirs"), F.max("exclude_files").alias("names"))
    parts = F.split("path", "/")
    j = f.files.where(F.col("path").isNotNull()).select("file_id", "project_id", "path").join(p, "project_id", "left")
    directory = F.coalesce(F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), "dirs"), F.lit(False))
    glob = lambda g: F.rlike(F.element_at(parts, -1), F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(g, r"([.+^$(){}\[\]|\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$")))
    return j.where(~directory & ~F.coalesce(F.exists("names", glob), F.lit(False))).select("file_id", "path")


_GLOB = "'^' || replace(replace(regexp_replace(g, '([.+^$(){}\\[\\]|\\\\])', '\\\\\\1', 'g'), '*', '.*'), '?', '.') || '$'"
add("src_visible", _visible,
    f"SELECT file_id, path FROM files LEFT JOIN (SELECT project_id, max(exclude_dirs) AS dirs, max(exclude_files) AS names FROM projects GROUP BY 1) USING (project_id) WHERE path IS NOT NULL AND NOT coalesce(list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), dirs), false) AND NOT coalesce(len(list_filter(names, lambda g: regexp_matches(string_split(path, '/')[-1], {_GLOB}))) > 0, false)", _FILES)


def _modified(f: Facts) -> DataFrame:
    """(path, hash, side): recorded and current hashes that differ, from both sides."""
    was = f.files.where(F.col("content_hash").isNotNull()).select("file_id", F.col("content_hash").alias("hash"))
    now = f.raw("source_texts").where(F.col("content").isNotNull()).select("file_id", F.sha2("content", 256).alias("hash")).distinct()
    return was.exceptAll(now).withColumn("side", F.lit("before")).unionByName(now.exceptAll(was).withColumn("side", F.lit("after")))


add("x_target_modified", _modified, "SELECT *, 'before' AS side FROM (SELECT file_id, content_hash AS hash FROM files WHERE content_hash IS NOT NULL EXCEPT SELECT * FROM now) UNION ALL SELECT *, 'after' FROM (SELECT * FROM now EXCEPT SELECT file_id, content_hash FROM files)",
    _FILES, "now AS (SELECT DISTINCT file_id, sha256(content) AS hash FROM source_texts WHERE content IS NOT NULL)")
add("o_early_stop", lambda f: qs.first_matches(rel.grep(f, r"\breturn\b").select("path", "line", "file_id"), [F.asc("path"), F.asc("line"), F.asc("file_id")], 50),
    "SELECT path, CAST(line AS INT) AS line, file_id, (SELECT count(*) FROM m) > 50 AS more FROM m ORDER BY path, line, file_id LIMIT 50", _FILES, _LINES, "m AS (SELECT path, line, file_id FROM lines WHERE regexp_matches(text, '\\breturn\\b'))")
add("o_budget", lambda f: qs.within_budget(f.symbols.join(f.files.select("file_id", "project_id"), "file_id").select("project_id", "sid", (F.col("end_line") - F.col("start_line") + 1).alias("span")), ["project_id"], [F.desc("span"), F.asc("sid")], "span", 2_000, "sid").select("project_id", "sid", F.col("total").cast("long").alias("total")),
    "SELECT project_id, sid, CAST(total AS BIGINT) AS total FROM (SELECT project_id, sid, sum(greatest(coalesce(span, 1), 1)) OVER (PARTITION BY project_id ORDER BY span DESC NULLS LAST, sid ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT project_id, sid, end_line - start_line + 1 AS span FROM syms JOIN files USING (file_id))) WHERE total <= 2000", _FILES, _SYM)

# -- scalar functions -----------------------------------------------------------------------------------------------------

_GLOSSARY = {"fetch": ["read", "load"], "delete": ["drop", "remove"]}


def _query_terms(text) -> F.Column:
    """Terms of three letters and more that are no stop words, with what a small glossary adds, and runs of Chinese and Japanese apart."""
    latin = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*more.STOP_WORDS))
    table = F.create_map(*[x for k, v in _GLOSSARY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    added = F.flatten(F.transform(latin, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    return F.array_union(F.array_union(latin, added), F.regexp_extract_all(text, F.lit("[\\u3040-\\u30ff\\u3400-\\u9fff]+"), F.lit(0)))


_LATIN = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))"
add("s_query_terms", lambda f: f.raw("documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(_query_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(list_concat({_LATIN}, flatten(list_transform({_LATIN}, lambda w: CASE w WHEN 'fetch' THEN ['read', 'load'] WHEN 'delete' THEN ['drop', 'remove'] ELSE [] END)), regexp_extract_all(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]+'))) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term")
add("s_group_of", lambda f: more.call_graph(f).join(f.symbols.select(F.col("sid").alias("dst"), "file_id"), "dst", "left").join(f.files.select("file_id", "path"), "file_id", "left").select("src", "dst", F.when(F.col("dst").startswith("external:"), "external").when(F.col("dst").startswith("open:"), "unresolved").when(F.col("path").isNull(), "elsewhere").otherwise(rel.component_of(F.col("path"), 99)).alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n")),
    "SELECT \"group\", count(*) AS n FROM (SELECT CASE WHEN starts_with(g.dst, 'external:') THEN 'external' WHEN starts_with(g.dst, 'open:') THEN 'unresolved' WHEN path IS NULL THEN 'elsewhere' WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '(root)' END AS \"group\" FROM g LEFT JOIN syms ON g.dst = sid LEFT JOIN files USING (file_id)) GROUP BY 1",
    _FILES, _SYM, _REF, "g AS (SELECT DISTINCT src, CASE WHEN status = 'resolved' AND dst IS NOT NULL THEN dst WHEN status = 'external' THEN 'external:' || coalesce(tname, '') ELSE 'open:' || coalesce(src, '') || ':' || coalesce(tname, '') END AS dst, CASE WHEN status <> 'resolved' THEN status ELSE confidence END AS style FROM rf WHERE kind = 'call')")
add("s_split_terms", lambda f: _split_terms(f),
    f"SELECT name, array_to_string(list_sort(list(DISTINCT stem)), ' ') AS terms FROM (SELECT name, {_NORM} AS stem FROM (SELECT name, unnest(CASE WHEN len(x) > 1 THEN list_append(x, lower(name)) ELSE x END) AS w FROM (SELECT name, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0) AS x FROM (SELECT DISTINCT name FROM syms WHERE name IS NOT NULL)))) GROUP BY name", _SYM)


def _split_terms(f: Facts) -> DataFrame:
    """The normalised words of each name, and of names of several words also the whole."""
    n = f.symbols.where(F.col("name").isNotNull()).select("name").distinct().withColumn("x", identifier_words(F.col("name")))
    w = n.select("name", F.explode(F.when(F.size("x") > 1, F.array_append("x", F.lower("name"))).otherwise(F.col("x"))).alias("w"))
    return w.select("name", more.normalize(F.col("w")).alias("stem")).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("stem")), " ").alias("terms"))


# -- containment, use, outside --------------------------------------------------------------------------------------------

_ANC = "anc AS (SELECT sid, pid AS ancestor FROM syms WHERE pid IN (SELECT sid FROM syms) UNION SELECT a.sid, s.pid FROM anc a JOIN syms s ON a.ancestor = s.sid WHERE s.pid IN (SELECT sid FROM syms))"
_ACYCLIC = "loop AS (SELECT DISTINCT sid FROM anc WHERE sid = ancestor)"
_IN = "ins AS (SELECT sid, ancestor FROM anc WHERE sid NOT IN (SELECT sid FROM loop) AND sid NOT IN (SELECT a.sid FROM anc a JOIN loop l ON a.ancestor = l.sid))"
add("g_parent_walk", lambda f: f.refs_of("src", "dst").where(F.col("dst").isNotNull()).join(qs.inside(f).select(F.col("sid").alias("src"), F.col("ancestor").alias("dst")), ["src", "dst"], "left_semi").select("reference_id", "src", "dst"),
    "SELECT DISTINCT reference_id, src, dst FROM rf JOIN ins ON src = sid AND dst = ancestor", _SYM, _REF, _ANC, _ACYCLIC, _IN, recursive=True)
_OPAQUE = "len(list_filter(coalesce(decorators, []), lambda d: trim(string_split(d, '(')[1]) NOT IN ('staticmethod', 'classmethod', 'property', 'abstractmethod', 'abc.abstractmethod', 'dataclass', 'dataclasses.dataclass'))) > 0"
add("u_unused_ranked", qs.unused_ranked,
    """SELECT sid, qname, path, CASE reason WHEN 'private' THEN 'high' WHEN 'public' THEN 'medium' ELSE 'low' END AS confidence, reason FROM (SELECT c.sid, qname, path, CASE WHEN only_tests THEN 'only tests' WHEN opaque THEN 'decorated' WHEN kind = 'method' AND pid IN (SELECT sid FROM syms WHERE kind = 'class' AND len(base_classes) > 0) THEN 'may override'
    WHEN name IN (SELECT string_split(tname, '.')[-1] FROM rf WHERE status IN ('unresolved', 'ambiguous') AND tname IS NOT NULL) THEN 'open call of that name' WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END AS reason FROM c LEFT JOIN used ON c.sid = used.sid WHERE only_tests IS NOT FALSE)""",
    _FILES, _SYM, _REF, _ANC, _ACYCLIC, _IN, f"sf AS (SELECT s.*, path, {_OPAQUE} AS opaque, {_TEST} AS test FROM syms s JOIN files USING (file_id))",
    "c AS (SELECT * FROM sf WHERE kind IN ('function', 'method', 'class') AND NOT test AND NOT regexp_matches(name, '^__.*__$') AND NOT (name = 'main' AND kind = 'function'))",
    "used AS (SELECT dst AS sid, bool_and(test) AS only_tests FROM (SELECT DISTINCT src, dst FROM rf WHERE kind IN ('call', 'name_ref', 'function_ref', 'inheritance', 'type_use', 'import', 'variable_ref') AND status = 'resolved' AND src <> dst) u JOIN sf ON u.src = sf.sid WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.sid = u.src AND ins.ancestor = u.dst) GROUP BY 1)", recursive=True)


def _longest_sql(table: dict[str, str], name: str) -> str:
    values = ", ".join(f"('{a}', '{b}')" for a, b in table.items())
    return f"(SELECT max_by(v, length(k)) FROM (VALUES {values}) t(k, v) WHERE {name} = k OR starts_with({name}, k || '.'))"


_EXT = [
    _FILES, _REF, _DEP,
    f"ed AS (SELECT *, coalesce({_longest_sql(qs.CATEGORIES, 'tname')}, CASE WHEN kind = 'import' THEN 'other' END) AS category FROM (SELECT dp.*, path FROM dp JOIN files USING (file_id) WHERE status = 'external' AND length(tname) > 0 AND stated IS DISTINCT FROM 'elisp'))",
    f"er AS (SELECT *, {_longest_sql(qs.CATEGORIES, 'tname')} AS category, CASE WHEN regexp_matches(string_split(tname, '.')[-1], '^[A-Z].*(Error|Exception|Warning|Exit|Interrupt)$') THEN 'pure' ELSE coalesce({_longest_sql(qs.OPERATIONS, 'tname')}, 'call') END AS operation FROM (SELECT DISTINCT reference_id, rf.file_id, src, tname, kind, start_line, status, path FROM rf JOIN files f ON rf.file_id = f.file_id WHERE length(tname) > 0))",
    "ex AS (SELECT category, tname AS library, 'import' AS operation, CAST(NULL AS VARCHAR) AS source, path, start_line AS line, kind, 'confirmed' AS confidence FROM ed WHERE category IS NOT NULL UNION ALL SELECT category, tname, operation, src, path, start_line, 'call', 'confirmed' FROM er WHERE status = 'external' AND kind IN ('call', 'name_ref') AND category IS NOT NULL AND operation <> 'pure' UNION ALL "
    f"SELECT 'filesystem', tname, CASE WHEN string_split(tname, '.')[-1] IN {qs.WRITE_METHODS} THEN 'write' ELSE 'read' END, src, path, start_line, 'call', 'inferred' FROM er WHERE status = 'unresolved' AND kind = 'call' AND contains(tname, '.') AND string_split(tname, '.')[-1] IN {qs.WRITE_METHODS + qs.READ_METHODS})",
]
add("u_externals", qs.externals, "SELECT * FROM ex", *_EXT)
_PARENT = f"SELECT r.node, r.distance, (SELECT min(c.src) FROM calls c JOIN ({_NEAREST}) p ON c.src = p.node AND p.distance = r.distance - 1 WHERE c.dst = r.node) AS parent FROM ({_NEAREST}) r"
add("g_effects_routes", lambda f: qs.effects(f, _seed_symbols(f, "src")),
    f"SELECT node, distance, parent, operation, count(*) AS n FROM ({_PARENT}) JOIN ex ON source = node WHERE kind = 'call' AND operation IN ('write', 'effect', 'output', 'io', 'read') GROUP BY ALL", _SYM, *_EXT, _CALLS, _SEED_SRC, _reach("calls", "src", "dst", 3), recursive=True)
add("g_impact_routes", lambda f: _impact(f),
    f"SELECT node, distance, parent, (SELECT any_value(c) FROM syms s JOIN comp USING (file_id) WHERE s.sid = node) AS component FROM (SELECT r.node, r.distance, (SELECT min(c.dst) FROM uses c JOIN ({_NEAREST}) p ON c.dst = p.node AND p.distance = r.distance - 1 WHERE c.src = r.node) AS parent FROM ({_NEAREST}) r)", _FILES, _SYM, _REF, _CALLS, _USES, _SEED_S, _COMP, _reach("uses", "dst", "src", 4), recursive=True)


def _impact(f: Facts) -> DataFrame:
    """What depends on the seeds, each with the next symbol on a shortest way and its component."""
    back = f.uses().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    at = f.symbols.join(f.files.select("file_id", rel.component_of(F.col("path"), 2).alias("component")), "file_id").select(F.col("sid").alias("node"), "component")
    return more.first_parents(back, _seed_symbols(f), 4).join(at, "node", "left").select("node", "distance", "parent", "component")


add("g_callers_usr", lambda f: _callers(f), "SELECT DISTINCT c.src, t.sid AS dst FROM calls c JOIN h ON c.dst = h.twin JOIN (SELECT node AS sid FROM seed) t ON h.sid = t.sid",
    _SYM, _REF, _CALLS, _SEED_S, "h AS (SELECT a.sid, b.sid AS twin FROM syms a JOIN syms b ON a.usr = b.usr AND length(a.usr) > 0 WHERE a.sid IN (SELECT node FROM seed) UNION SELECT sid, sid FROM syms)")


def _callers(f: Facts) -> DataFrame:
    """Callers of the seeds, of their declarations and of their other definitions: all with the same USR. The seeds are few, so each is joined with all of its USR."""
    seeds = _seed_symbols(f).select(F.col("node").alias("sid"))
    u = f.symbols.join(seeds, "sid", "left_semi").where(F.length("usr") > 0).select("sid", "usr")
    twins = u.join(f.symbols.select("usr", F.col("sid").alias("twin")), "usr").select("sid", "twin").union(seeds.select("sid", F.col("sid").alias("twin"))).distinct()
    return f.calls().select("src", F.col("dst").alias("twin")).distinct().join(twins, "twin").select("src", F.col("sid").alias("dst")).distinct()


add("g_deps_graph", lambda f: f.deps.select(F.col("file_id").alias("src"), F.when((F.col("status") == "resolved") & F.col("target_file_id").isNotNull(), F.col("target_file_id")).when(F.col("status") == "external", F.concat(F.lit("external:"), F.coalesce("tname", F.lit("")))).otherwise(F.concat_ws(":", F.lit("open"), F.col("file_id"), F.coalesce("tname", F.lit("")))).alias("dst"), "kind", "status").groupBy("src", "dst", "kind", "status").agg(F.count(F.lit(1)).alias("n")),
    "SELECT file_id AS src, CASE WHEN status = 'resolved' AND target_file_id IS NOT NULL THEN target_file_id WHEN status = 'external' THEN 'external:' || coalesce(tname, '') ELSE concat_ws(':', 'open', file_id, coalesce(tname, '')) END AS dst, kind, status, count(*) AS n FROM dp GROUP BY ALL", _DEP)


def _arch(f: Facts) -> DataFrame:
    """The graph of components; an edge with a dependency against the order of layers is marked."""
    c = f.files.select("file_id", "project_id", rel.component_of(F.col("path"), 2).alias("component"))
    bad = _violations(f).withColumn("against", F.lit(1))
    e = f.file_edges().join(c.select(F.col("file_id").alias("src"), "project_id", F.col("component").alias("source")), "src").join(c.select(F.col("file_id").alias("dst"), F.col("component").alias("target")), "dst").where(F.col("source") != F.col("target")).join(bad, ["src", "dst"], "left")
    return e.groupBy("project_id", "source", "target").agg(F.count(F.lit(1)).alias("n"), F.count("against").alias("n_against")).withColumn("style", F.when(F.col("n_against") > 0, "inferred").otherwise("confirmed"))


_LV = "lv AS (SELECT file_id, CASE split_part(path, '/', 1) " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in _ROLES) + " END AS v FROM files)"
add("g_arch", _arch, "SELECT a.project_id, a.c AS source, b.c AS target, count(*) AS n, count(*) FILTER (x.v > y.v) AS n_against, CASE WHEN count(*) FILTER (x.v > y.v) > 0 THEN 'inferred' ELSE 'confirmed' END AS style FROM fe JOIN comp a ON fe.src = a.file_id JOIN comp b ON fe.dst = b.file_id LEFT JOIN lv x ON fe.src = x.file_id LEFT JOIN lv y ON fe.dst = y.file_id WHERE a.c <> b.c GROUP BY 1, 2, 3", _FILES, _DEP, _FE, _COMP, _LV)
_ROUTE = r"(^|\.)(route|get|post|put|delete|command|group|task)(\(|$)"


def _entries(f: Facts) -> DataFrame:
    """Symbols that something outside calls: main, those with a decorator of routes or commands, and functions handed over by name."""
    named = f.symbols.where((F.col("name") == "main") | F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d.rlike(_ROUTE))).select("sid")
    handed = f.refs_of("dst", "kind", "status").where((F.col("kind") == "function_ref") & (F.col("status") == "resolved")).select(F.col("dst").alias("sid"))
    return f.symbols.select("sid").join(named.union(handed).distinct(), "sid", "left_semi")


add("u_entry_ids", _entries, f"SELECT sid FROM syms WHERE name = 'main' OR len(list_filter(coalesce(decorators, []), lambda d: regexp_matches(d, '{_ROUTE}'))) > 0 OR sid IN (SELECT dst FROM rf WHERE kind = 'function_ref' AND status = 'resolved' AND dst IS NOT NULL)", _SYM, _REF)
add("u_stale_findings", lambda f: rel.grep(f, r"\b(TODO|FIXME)\b").select("file_id", "line").join(rel.freshness(f), "file_id").select("file_id", "line", (F.col("state") != "fresh").alias("stale")),
    r"SELECT l.file_id, CAST(line AS INT) AS line, state <> 'fresh' AS stale FROM lines l JOIN fr USING (file_id) WHERE regexp_matches(text, '\b(TODO|FIXME)\b')", _FILES, _LINES, _FRESH)
add("c_stale", lambda f: more.citations(f).where(F.col("status") == "stale").select("doc_id", "path").distinct(),
    "SELECT DISTINCT doc_id, c.path FROM c JOIN (SELECT project_id, path, max(state) AS state FROM fr GROUP BY 1, 2) k ON c.project_id = k.project_id AND c.path = k.path WHERE k.state = 'stale'",
    _FILES, _FRESH, r"c AS (SELECT DISTINCT doc_id, project_id, regexp_extract(c, '^(.*):', 1) AS path FROM (SELECT doc_id, project_id, unnest(regexp_extract_all(text, '\[([\w./-]+:\d+(?:-\d+)?)\]', 1)) AS c FROM documents))")


def _field_owner(f: Facts) -> DataFrame:
    """(reference_id, owner): the smallest function or method around each reference's line; null outside of all. As rel.innermost_owner, by blocks of lines."""
    block = 64
    r = f.refs_of("file_id", "start_line").withColumn("block", F.floor(F.col("start_line") / block))
    s = f.symbols.where(F.col("kind").isin("function", "method") & (F.col("start_line") <= F.col("end_line"))).select("file_id", "sid", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    s = s.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))))
    best = r.join(s, ["file_id", "block"]).where(F.col("start_line").between(F.col("a"), F.col("b"))).groupBy("reference_id").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("size"), "sid")).alias("m"))
    return r.select("reference_id").distinct().join(best.select("reference_id", F.col("m.sid").alias("owner")), "reference_id", "left")


add("j_field_owner", _field_owner, "SELECT DISTINCT r.reference_id, i.o AS owner FROM rf r LEFT JOIN i USING (reference_id)", _SYM, _REF,
    "i AS (SELECT reference_id, min({'size': s.end_line - s.start_line, 'sid': s.sid}).sid AS o FROM rf r JOIN syms s ON r.file_id = s.file_id AND r.start_line BETWEEN s.start_line AND s.end_line WHERE s.kind IN ('function', 'method') GROUP BY 1)")
add("u_understand", lambda f: qs.understand(f, _seed_symbols(f)),
    f"""SELECT dst AS node, 'caller' AS question, src AS item, 1 AS n FROM calls WHERE dst IN (SELECT node FROM seed) UNION ALL SELECT src, 'callee', dst, 1 FROM calls WHERE src IN (SELECT node FROM seed)
    UNION ALL SELECT src, 'open', coalesce(tname, ''), count(*) FROM (SELECT DISTINCT reference_id, src, kind, status, tname FROM rf) WHERE kind = 'call' AND status IN ('unresolved', 'ambiguous') AND src IN (SELECT node FROM seed) GROUP BY ALL
    UNION ALL SELECT source, 'outside', operation, count(*) FROM ex WHERE kind = 'call' AND source IN (SELECT node FROM seed) GROUP BY ALL
    UNION ALL SELECT origin, 'test', node, min(d) FROM w WHERE node <> origin AND node IN (SELECT sid FROM syms JOIN files USING (file_id) WHERE {_TEST}) GROUP BY 1, 3 HAVING min(d) <= 3
    UNION ALL SELECT origin, 'impact', 'symbols', count(DISTINCT node) FROM w WHERE node <> origin GROUP BY 1""",
    _SYM, *_EXT, _CALLS, _USES, _SEED_S, "w AS (SELECT node AS origin, node, 0 AS d FROM seed UNION SELECT origin, u.src, d + 1 FROM w JOIN uses u ON u.dst = w.node WHERE d < 4)", recursive=True)
add("c_context", lambda f: _context(f),
    """SELECT qid, sid, CAST(total AS BIGINT) AS total FROM (SELECT qid, sid, sum(size) OVER (PARTITION BY qid ORDER BY size, sid ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT w AS qid, sid, greatest(coalesce(sum(end_line - start_line + 1), 1), 1) AS size FROM syms JOIN (VALUES ('ledger'), ('lattice')) v(w) ON contains(lower(name), w) WHERE kind IN ('function', 'method') GROUP BY 1, 2)) WHERE total <= 600""", _SYM)  # fmt: skip


def _context(f: Facts) -> DataFrame:
    """For each question the shortest functions that its word names, while their lines together fit the budget of 600."""
    s = f.symbols.where(F.col("kind").isin("function", "method"))
    hit = None
    for w in ("ledger", "lattice"):
        part = s.where(F.contains(F.lower("name"), F.lit(w))).select(F.lit(w).alias("qid"), "sid", F.greatest(F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(1)), F.lit(1)).alias("size"))
        hit = part if hit is None else hit.unionByName(part)
    return qs.within_budget(hit, ["qid"], [F.asc("size"), F.asc("sid")], "size", 600, "sid").select("qid", "sid", F.col("total").cast("long").alias("total"))


# -- functions in all languages: no SQL, tested on small sources -------------------------------------------------------------

_C, _EL = ("c", "cpp", "go"), ("elisp",)
for _name, _what, _languages in (
    ("p_flow_c", "flows", _C), ("p_flow_el", "flows", _EL), ("p_vars_c", "variables", _C), ("p_vars_el", "variables", _EL), ("p_state_c", "states", _C), ("p_state_el", "states", _EL), ("p_points_to", "aliases", _C), ("p_exits_c", "exits", _C), ("p_exits_el", "exits", _EL),
    ("p_returns_c", "returns", _C), ("g_cfg_c", "blocks", _C), ("g_cfg_el", "blocks", _EL), ("p_params", "parameters", ("python", *_C, *_EL)), ("p_returns", "returns", ("python",)), ("p_mutations", "mutations", ("python",)),
):
    add(_name, _code(_what, *_languages))
_SETTINGS = ("env-read", "env-write", "cli-option", "config-path")
add("p_config_c", lambda f: _code("findings", *_C)(f).where(F.col("rule").isin(*_SETTINGS)))
add("p_env", lambda f: _code("findings", "python", *_C)(f).where(F.col("rule").isin("env-platform", "env-executable")).groupBy("rule", "detail").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files")).unionByName(_code("deps", "c", "cpp")(f).groupBy(F.lit("c-header").alias("rule"), F.col("target").alias("detail")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files"))))
add("u_config_uses", lambda f: qs.config_uses(_code("findings", "python", *_C)(f), _code("variables", "python", *_C)(f)))


def _known(f: Facts, *languages: str) -> DataFrame:
    return qs.known_calls(_code("refs", *languages)(f), _code("flows", *languages)(f))


def _first_values(f: Facts, *languages: str) -> DataFrame:
    p = _code("variables", *languages)(f).where((F.col("what") == "def") & (F.col("how") == "param") & (F.col("to") == "0"))
    return p.select(F.concat_ws(":", "qname", "name").alias("node")).distinct()


add("p_trace_c", lambda f: functions.trace(_code("variables", *_C)(f), _first_values(f, *_C), 4))
add("p_up_c", lambda f: functions.trace(_code("variables", *_C)(f), _first_values(f, *_C), 4, True))
add("p_trace_el", lambda f: functions.trace(_code("variables", *_EL)(f), _first_values(f, *_EL), 4))
add("p_ptr", lambda f: functions.pointer_trace(_code("variables", *_C)(f), _code("aliases", *_C)(f), _first_values(f, *_C), 4))
add("g_exit_propagate", lambda f: qs.exit_reach(_code("exits", *_C)(f).where(F.col("kind").isin("terminate", "longjmp", "throw")), _known(f, *_C)))
add("g_el_signal", lambda f: functions.exception_flow(_code("exceptions", *_EL)(f), _known(f, *_EL).select("source", "target", "line")))
add("a_caught_by", lambda f: qs.caught_by(_code("exceptions", "python")(f), _known(f, "python")))

# -- SQL of graph queries that had none --------------------------------------------------------------------------------------

_CLOSED = "cl AS (SELECT src AS a, dst AS b FROM {e} UNION SELECT a, dst FROM cl JOIN {e} ON b = src)"
ORACLE["g_scc"] = f"WITH RECURSIVE {_REF}, {_CALLS}, {_CLOSED.format(e='calls')} SELECT c.a AS node, max(c.b) AS component FROM cl c JOIN cl d ON c.a = d.b AND c.b = d.a GROUP BY 1 HAVING count(*) > 1"
ORACLE["g_layers"] = f"""WITH RECURSIVE {_DEP}, {_FE}, {_CLOSED.format(e='fe')}, nd AS (SELECT src AS node FROM fe UNION SELECT dst FROM fe),
  cp AS (SELECT node, coalesce((SELECT max(c.b) FROM cl c JOIN cl d ON c.a = d.b AND c.b = d.a WHERE c.a = node), node) AS component FROM nd),
  dag AS (SELECT DISTINCT x.component AS a, y.component AS b FROM fe JOIN cp x ON src = x.node JOIN cp y ON dst = y.node WHERE x.component <> y.component),
  lv AS (SELECT DISTINCT component, 0 AS l FROM cp UNION SELECT a, l + 1 FROM lv JOIN dag ON b = component)
  SELECT node, cp.component, CAST(max(l) AS INT) AS level FROM cp JOIN lv ON cp.component = lv.component GROUP BY 1, 2"""


def _exception_bases(f: Facts) -> DataFrame:
    """(name, base): the builtin exceptions with their bases, by Python's own classes, and the project's classes with theirs, direct or not."""
    import builtins

    from factloom.sources.python_source import builtin_bases

    known = [(n, b) for n in dir(builtins) for b in builtin_bases(n)[1:]]
    return f.spark.createDataFrame(known, "name string, base string").unionByName(more.base_names(f).select("name", "base")).distinct()


add("g_exc_propagate", lambda f: functions.exception_flow(_code("exceptions", "python")(f), _known(f, "python").select("source", "target", "line"), bases=_exception_bases(f)))
add("o_refs_in_order", rel.references_in_order, "SELECT reference_id, file_id, start_line, tname FROM rf ORDER BY file_id, start_line, tname NULLS FIRST, reference_id", _REF)
