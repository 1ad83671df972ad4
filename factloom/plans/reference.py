"""Queries of the reference's own operators over the fact tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from factloom.facts import Facts
from factloom.functions.text import identifier_words
from factloom.operators import functions, graph, more, relational as rel, resolve, retrieval
from factloom.sources.code import facts_of
from factloom.sources.tables import EXTENSION_LANGUAGE

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# -- the cleaned tables in SQL ----------------------------------------------------------------------------------------

_B = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)||chr(12288)"
_REST = ["project_id", "relative_path", "language", "content_hash", "analysis_status", "analyzer_version"]
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSION_LANGUAGE.items())
_FILES = f"""files AS (SELECT *, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) {_CASES} END AS stated FROM (
  SELECT *, regexp_replace(regexp_replace(replace(trim(relative_path, {_B}), '\\', '/'), '/{{2,}}', '/', 'g'), '^(\\./)+', '') AS path FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY last_analyzed_at DESC NULLS LAST, {", ".join(f"{c} DESC NULLS LAST" for c in _REST)}) AS rn
    FROM source_files WHERE file_id IS NOT NULL) WHERE rn = 1))"""
_ID = lambda c: f"nullif(lower(trim({c}, {_B})), '')"
_SYM = f"""syms AS (SELECT sid, symbol_id, pid, file_id, name, coalesce(CASE WHEN length(trim(qualified_name, {_B})) > 0 THEN qualified_name END, name) AS qname,
  lower(trim(kind, {_B})) AS kind, start_line, end_line, decorators, base_classes, usr, summary, is_async FROM (
  SELECT {_ID("symbol_id")} AS sid, min(symbol_id) AS symbol_id, min({_ID("parent_symbol_id")}) AS pid, min(file_id) AS file_id, min(name) AS name, min(qualified_name) AS qualified_name,
    min(kind) AS kind, min(start_line) AS start_line, min(end_line) AS end_line, min(decorators) AS decorators, min(base_classes) AS base_classes, min(usr) AS usr, min(summary) AS summary, min(is_async) AS is_async
  FROM symbols GROUP BY 1) WHERE sid IS NOT NULL)"""
_REF = f"""rf AS (SELECT DISTINCT reference_id, file_id, {_ID("source_symbol_id")} AS src, {_ID("target_symbol_id")} AS dst, trim(target_name, {_B}) AS tname, lower(trim(reference_kind, {_B})) AS kind,
  start_line, lower(trim(resolution_status, {_B})) AS status, lower(trim(confidence, {_B})) AS confidence, note FROM refs)"""
_DEP = f"""dp AS (SELECT * EXCLUDE (is_candidate) FROM (SELECT DISTINCT dependency_id, source_file_id AS file_id, target_file_id, trim(target_name, {_B}) AS tname, lower(trim(dependency_kind, {_B})) AS kind,
  start_line, lower(trim(resolution_status, {_B})) AS status, lower(trim(confidence, {_B})) AS confidence, coalesce(is_candidate, false) AS is_candidate FROM deps) WHERE NOT is_candidate OR status = 'resolved')"""
_CALLS = "calls AS (SELECT DISTINCT src, dst FROM rf WHERE kind = 'call' AND status = 'resolved' AND src <> dst)"
_USES = "uses AS (SELECT DISTINCT src, dst FROM rf WHERE kind IN ('call', 'name_ref', 'function_ref', 'inheritance', 'type_use') AND status = 'resolved' AND src <> dst)"
_FE = "fe AS (SELECT DISTINCT file_id AS src, target_file_id AS dst FROM dp WHERE status = 'resolved' AND file_id <> target_file_id)"


def add(name: str, query, sql: str | None = None, *ctes: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda s, d: query(Facts(s, d))
    if sql:
        ORACLE[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else "") + sql


def _seed_files(f: Facts) -> DataFrame:
    """The three files with the most dependents."""
    return f.file_edges().groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(3).select(F.col("dst").alias("node"))


def _seed_symbols(f: Facts, column: str = "dst") -> DataFrame:
    """The three symbols with the most callers in the projects, or the most callees."""
    known = f.symbols.select(F.col("sid").alias(column))
    return f.calls().select("src", "dst").distinct().join(known, column, "left_semi").groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(3).select(F.col(column).alias("node"))


_SEED_F = "seed AS (SELECT dst AS node FROM fe GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"
_SEED_S = "seed AS (SELECT dst AS node FROM calls WHERE dst IN (SELECT sid FROM syms) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"
_SEED_SRC = "seed AS (SELECT src AS node FROM calls WHERE src IN (SELECT sid FROM syms) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"


def _reach(edges: str, a: str, b: str, depth: int) -> str:
    return f"reach AS (SELECT node, 0 AS d FROM seed UNION SELECT e.{b}, r.d + 1 FROM reach r JOIN {edges} e ON e.{a} = r.node WHERE r.d < {depth})"


_NEAREST = "SELECT node, CAST(min(d) AS INT) AS distance FROM reach GROUP BY node"

# -- 2.3 filters ------------------------------------------------------------------------------------------------------

_M = "SELECT sid, qname, kind, path, s.start_line FROM syms s JOIN files f USING (file_id) WHERE "
add("f_symbol_exact", lambda f: rel.match_symbols(f, "name_of", "exact"), _M + "name = 'name_of' OR qname = 'name_of'", _FILES, _SYM)
add("f_symbol_prefix", lambda f: rel.match_symbols(f, "Sort_", "prefix"), _M + "starts_with(lower(name), 'sort_') OR starts_with(lower(qname), 'sort_')", _FILES, _SYM)
add("f_symbol_substring", lambda f: rel.match_symbols(f, "Ledger", "substring"), _M + "contains(lower(qname), 'ledger')", _FILES, _SYM)
add("f_file_match", lambda f: f.files.where(F.contains(F.lower("path"), F.lit("vendor"))).select("file_id", "path"), "SELECT file_id, path FROM files WHERE contains(lower(path), 'vendor')", _FILES)
add("f_lookup", lambda f: rel.lookup(f, "name_of"),
    """SELECT sid, qname, kind, CAST(tier AS INT) AS tier FROM b WHERE kind IS DISTINCT FROM 'local_variable' OR (SELECT count(*) FROM b WHERE kind IS DISTINCT FROM 'local_variable') = 0""", _SYM,
    "t AS (SELECT *, CASE WHEN qname = 'name_of' THEN 0 WHEN name = 'name_of' THEN 1 WHEN regexp_matches(qname, '(\\.|/|::)name_of$') THEN 2 END AS tier FROM syms)",
    "b AS (SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t))")
_LINES = "lines AS (SELECT file_id, path, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS text FROM (SELECT file_id, path, string_split_regex(content, '\\r\\n|\\n') AS x FROM files JOIN source_texts USING (file_id) WHERE stated IS NOT NULL AND content IS NOT NULL))"
add("f_text_grep", lambda f: rel.grep(f, r"\bTODO\b").select("file_id", "path", "line", "text"), "SELECT file_id, path, CAST(line AS INT) AS line, text FROM lines WHERE regexp_matches(text, '\\bTODO\\b')", _FILES, _LINES)
add("f_text_grep_any_case", lambda f: rel.grep(f, r"fixme|hack", True), "SELECT file_id, path, CAST(line AS INT) AS line, text FROM lines WHERE regexp_matches(text, '(?i)fixme|hack')", _FILES, _LINES)
add("f_exclude", lambda f: rel.without(f, ["*/vendor/*", "*.js"])[2].groupBy("kind").agg(F.count_distinct("reference_id").alias("n")),
    """SELECT kind, count(DISTINCT reference_id) AS n FROM rf WHERE file_id IN (SELECT file_id FROM kept) AND dst NOT IN (SELECT sid FROM syms WHERE file_id NOT IN (SELECT file_id FROM kept)) IS NOT FALSE GROUP BY kind""",
    _FILES, _SYM, _REF, "kept AS (SELECT file_id FROM files WHERE NOT (regexp_matches(path, '^.*/vendor/.*$') OR regexp_matches(path, '^.*\\.js$')))")
add("f_under", lambda f: f.symbols.join(f.files.where(F.col("path").startswith("core/")).select("file_id"), "file_id", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "SELECT kind, count(*) AS n FROM syms WHERE file_id IN (SELECT file_id FROM files WHERE starts_with(path, 'core/')) GROUP BY kind", _FILES, _SYM)
add("f_visible_dep", lambda f: f.deps.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, status, count(*) AS n FROM dp GROUP BY ALL", _DEP)
add("f_unresolved", rel.unresolved, "SELECT note, status, count(DISTINCT reference_id) AS n FROM rf WHERE status IN ('unresolved', 'ambiguous') GROUP BY ALL", _REF)
add("f_unresolved_inbox", rel.inbox,
    """SELECT o.src AS sid, s.qname, count(*) FILTER (status = 'unresolved') AS n_unresolved, count(*) FILTER (status = 'ambiguous') AS n_ambiguous,
    string_agg(concat_ws(':', o.start_line, coalesce(tname, '')), ', ' ORDER BY r) FILTER (r <= 30) AS first_targets FROM o JOIN syms s ON o.src = s.sid GROUP BY ALL""", _SYM, _REF,
    "o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY start_line, tname, reference_id) AS r FROM rf WHERE kind = 'call' AND status IN ('unresolved', 'ambiguous'))")
add("f_marks", lambda f: f.refs.where((F.col("kind") == "call") & (F.col("status").isin("unresolved", "ambiguous") | (F.col("confidence") == "inferred"))).select("file_id", "start_line", F.when(F.col("status") == "resolved", "inferred").otherwise(F.col("status")).alias("mark")).groupBy("file_id", "start_line", "mark").agg(F.count(F.lit(1)).alias("n")),
    "SELECT file_id, start_line, CASE WHEN status = 'resolved' THEN 'inferred' ELSE status END AS mark, count(*) AS n FROM rf WHERE kind = 'call' AND (status IN ('unresolved', 'ambiguous') OR confidence = 'inferred') GROUP BY ALL", _REF)
add("f_test_path", lambda f: f.files.select("file_id", F.coalesce(rel.test_path(F.col("path")), F.lit(False)).alias("is_test")),
    r"SELECT file_id, coalesce(regexp_matches(lower(path), '(^|/)(tests?|testing|spec)/|(^|/)test_[^/]*$|_test\.[a-z]+$|(^|/)conftest\.py$'), false) AS is_test FROM files", _FILES)
add("f_prefix_id", lambda f: f.symbols.where(F.col("sid").startswith("0a")).select("sid", "qname"), "SELECT sid, qname FROM syms WHERE starts_with(sid, '0a')", _SYM)

# -- 2.4 joins --------------------------------------------------------------------------------------------------------

add("j_project", lambda f: f.symbols.join(f.files.select("file_id", "project_id"), "file_id").groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("n")), "SELECT project_id, s.kind, count(*) AS n FROM syms s JOIN files USING (file_id) GROUP BY ALL", _FILES, _SYM)
add("j_ref_hit", rel.ref_hits, "SELECT reference_id, a.qname AS source, b.qname AS target, tname, r.kind, path, r.start_line, status FROM rf r JOIN syms a ON r.src = a.sid JOIN files f ON r.file_id = f.file_id LEFT JOIN syms b ON r.dst = b.sid", _FILES, _SYM, _REF)
add("j_dep_hit", rel.dep_hits, "SELECT dependency_id, a.path AS source_path, b.path AS target_path, tname, kind, status FROM dp d JOIN files a ON d.file_id = a.file_id LEFT JOIN files b ON d.target_file_id = b.file_id", _FILES, _DEP)
add("j_usr_group", lambda f: rel.same_usr(f.symbols).groupBy("sid").agg(F.count(F.lit(1)).alias("n_twins")),
    """SELECT s.sid, 1 + CASE WHEN h.n > 1 THEN CASE WHEN s.sid = h.head THEN h.n - 1 ELSE 1 END ELSE 0 END AS n_twins FROM syms s LEFT JOIN h ON s.usr = h.usr""", _SYM,
    "h AS (SELECT usr, min(sid) AS head, count(*) AS n FROM syms WHERE length(usr) > 0 GROUP BY usr)")
add("j_owner", rel.innermost_owner,
    """SELECT r.reference_id, coalesce(i.o, m.sid) AS owner FROM (SELECT DISTINCT reference_id, file_id, start_line FROM rf) r LEFT JOIN i USING (reference_id) LEFT JOIN m ON r.file_id = m.file_id""", _SYM, _REF,
    "i AS (SELECT reference_id, min({'size': s.end_line - s.start_line, 'sid': s.sid}).sid AS o FROM rf r JOIN syms s ON r.file_id = s.file_id AND r.start_line BETWEEN s.start_line AND s.end_line WHERE s.kind IN ('function', 'method', 'class', 'struct') GROUP BY 1)",
    "m AS (SELECT file_id, min(sid) AS sid FROM syms WHERE kind = 'module' GROUP BY 1)")
add("j_suffix_qname", lambda f: rel.suffix_matches(f.refs_of("tname").where(F.length("tname") > 0).select(F.col("tname").alias("name")), f.symbols),
    """SELECT name, count(*) FILTER (tier = 0) AS n_exact, count(*) FILTER (tier = 1) AS n_suffix, CASE WHEN n_exact = 1 THEN min(sid) FILTER (tier = 0) WHEN n_exact = 0 AND n_suffix = 1 THEN min(sid) FILTER (tier = 1) END AS unique_sid FROM hits GROUP BY name""", _SYM, _REF,
    "names AS (SELECT DISTINCT tname AS name FROM rf WHERE length(tname) > 0)",
    "p AS (SELECT sid, qname, regexp_extract_all(qname, '::|[./]') AS marks, string_split_regex(qname, '::|[./]') AS parts FROM syms)",
    "tails AS (SELECT sid, qname, unnest(range(1, len(parts))) AS k, marks, parts FROM p WHERE len(parts) > 1)",
    "tail AS (SELECT sid, list_reduce(list_prepend(parts[k + 1], list_transform(range(k + 1, len(parts)), lambda j: marks[j] || parts[j + 1])), lambda a, b: a || b) AS name FROM tails)",
    "hits AS (SELECT n.name, s.sid, 0 AS tier FROM names n JOIN syms s ON s.qname = n.name UNION ALL SELECT n.name, t.sid, 1 FROM names n JOIN tail t ON t.name = n.name)")
_CATEGORIES = [("fmt", "print"), ("os", "filesystem"), ("os.path", "path"), ("os.Open", "open"), ("json", "format"), ("subprocess", "process"), ("fmt.Errorf", "error")]
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _CATEGORIES)
add("j_longest_prefix", lambda f: rel.longest_prefix(f.refs_of("tname", "status").where((F.col("status") == "external") & (F.length("tname") > 0)).select(F.col("tname").alias("name")), f.spark.createDataFrame(_CATEGORIES, "prefix string, category string")),
    "SELECT name, max_by(prefix, length(prefix)) AS prefix, max_by(category, length(prefix)) AS category FROM (SELECT DISTINCT tname AS name FROM rf WHERE status = 'external' AND length(tname) > 0) JOIN c ON name = prefix OR starts_with(name, prefix || '.') GROUP BY name",
    _REF, f"c AS (SELECT * FROM (VALUES {_VALUES}) v(prefix, category))")
add("j_stale_anti", lambda f: f.symbols.join(rel.freshness(f).where(F.col("state") == "stale").select("file_id"), "file_id", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "SELECT kind, count(*) AS n FROM syms WHERE file_id IS NULL OR file_id NOT IN (SELECT f.file_id FROM files f JOIN source_texts t ON f.file_id = t.file_id WHERE content_hash IS NOT NULL AND content IS NOT NULL AND sha256(content) <> content_hash) GROUP BY kind", _FILES, _SYM)
add("j_library", lambda f: f.refs_of("dst").join(f.raw("library_symbols").select(F.lower(F.trim("symbol_id")).alias("dst"), "library"), "dst").groupBy("library").agg(F.count_distinct("reference_id").alias("n")),
    "SELECT library, count(DISTINCT reference_id) AS n FROM rf JOIN library_symbols l ON rf.dst = lower(trim(l.symbol_id)) GROUP BY library", _REF)
add("j_dangling", lambda f: f.refs_of("dst").where(F.col("dst").isNotNull()).join(f.symbols.select(F.col("sid").alias("dst")).union(f.raw("library_symbols").select(F.lower(F.trim("symbol_id")))), "dst", "left_anti").groupBy("dst").agg(F.count(F.lit(1)).alias("n")),
    "SELECT dst, count(DISTINCT reference_id) AS n FROM rf WHERE dst IS NOT NULL AND dst NOT IN (SELECT sid FROM syms UNION SELECT lower(trim(symbol_id)) FROM library_symbols) GROUP BY dst", _SYM, _REF)

# -- 2.5 aggregations -------------------------------------------------------------------------------------------------

add("a_lang_counts", lambda f: f.files.groupBy("stated").agg(F.count(F.lit(1)).alias("n")), "SELECT stated, count(*) AS n FROM files GROUP BY stated", _FILES)
add("a_kind_counts", lambda f: f.symbols.where(F.col("kind") != "local_variable").groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM syms WHERE kind <> 'local_variable' GROUP BY kind", _SYM)
add("a_status_counts", lambda f: f.refs_of("status", "confidence").groupBy("status", "confidence").agg(F.count(F.lit(1)).alias("n")), "SELECT status, confidence, count(*) AS n FROM rf GROUP BY ALL", _REF)
_FAN = "fan AS (SELECT f.file_id, (SELECT count(*) FROM fe WHERE dst = f.file_id) AS fan_in, (SELECT count(*) FROM fe WHERE src = f.file_id) AS fan_out FROM files f)"
add("a_fan", rel.fan, "SELECT * FROM fan", _FILES, _DEP, _FE, _FAN)
add("a_modules", rel.modules,
    "SELECT f.file_id, f.path, coalesce(definitions, 0) AS definitions, coalesce(lines, 0) AS lines, fan_in, fan_out FROM files f LEFT JOIN (SELECT file_id, count(*) FILTER (kind IN ('function', 'method', 'class', 'struct', 'macro')) AS definitions, max(end_line) AS lines FROM syms GROUP BY 1) p USING (file_id) JOIN fan USING (file_id)",
    _FILES, _SYM, _DEP, _FE, _FAN)
add("a_most_called", rel.most_called, "SELECT sid, qname, count(*) AS n FROM calls JOIN syms ON dst = sid GROUP BY 1, 2 ORDER BY n DESC, qname, sid LIMIT 20", _SYM, _REF, _CALLS)
add("a_most_calling", rel.most_calling, "SELECT sid, qname, count(*) AS n FROM calls JOIN syms ON src = sid GROUP BY 1, 2 ORDER BY n DESC, qname, sid LIMIT 20", _SYM, _REF, _CALLS)
add("a_caller_counts", lambda f: rel.most_called(f, None), "SELECT sid, qname, count(*) AS n FROM calls JOIN syms ON dst = sid GROUP BY 1, 2", _SYM, _REF, _CALLS)
add("a_edge_merge", rel.merged_edges,
    "SELECT src, dst, kind, style, count(*) AS n, min(start_line) AS first_line, coalesce(string_agg(DISTINCT note, ' / ' ORDER BY note) FILTER (length(note) > 0), '') AS notes FROM (SELECT *, CASE WHEN status = 'external' THEN 'external' WHEN status <> 'resolved' THEN 'unresolved' WHEN confidence = 'inferred' THEN 'inferred' ELSE 'confirmed' END AS style FROM rf WHERE dst IS NOT NULL) GROUP BY src, dst, kind, style", _REF)
_COMP = "comp AS (SELECT file_id, project_id, CASE WHEN len(string_split(path, '/')) < 2 THEN '(root)' ELSE array_to_string(list_slice(string_split(path, '/'), 1, least(2, len(string_split(path, '/')) - 1)), '/') END AS c FROM files)"
add("a_component", rel.component_edges, "SELECT a.project_id, a.c AS source, b.c AS target, count(*) AS n FROM fe JOIN comp a ON fe.src = a.file_id JOIN comp b ON fe.dst = b.file_id WHERE a.c <> b.c GROUP BY ALL", _FILES, _DEP, _FE, _COMP)
add("a_describe", rel.described,
    """SELECT sid, qname, (SELECT count(*) FROM syms m WHERE m.pid = s.sid) AS n_members, (SELECT count(*) FROM calls WHERE dst = s.sid) AS n_callers, (SELECT count(*) FROM calls WHERE src = s.sid) AS n_callees,
    coalesce(i.n, 0) AS n_incoming, coalesce(i.f, 0) AS n_files FROM syms s LEFT JOIN (SELECT dst, count(DISTINCT reference_id) AS n, count(DISTINCT file_id) AS f FROM rf WHERE status = 'resolved' GROUP BY 1) i ON i.dst = s.sid""", _SYM, _REF, _CALLS)  # fmt: skip
add("a_pending", lambda f: f.refs_of("src", "kind", "status").where((F.col("kind") == "call") & F.col("status").isin("unresolved", "ambiguous")).groupBy("src").agg(F.count(F.lit(1)).alias("n")), "SELECT src, count(*) AS n FROM rf WHERE kind = 'call' AND status IN ('unresolved', 'ambiguous') GROUP BY src", _REF)
add("a_usage_groups", lambda f: f.refs_of("tname", "status", "file_id").where((F.col("status") == "external") & (F.length("tname") > 0)).groupBy(F.split("tname", r"::|\.")[0].alias("library"), "tname").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("n_files")),
    "SELECT string_split_regex(tname, '::|\\.')[1] AS library, tname, count(*) AS n, count(DISTINCT file_id) AS n_files FROM rf WHERE status = 'external' AND length(tname) > 0 GROUP BY ALL", _REF)


def _commits(f: Facts) -> DataFrame:
    """Orders as commits and the brands of their parts as paths, as the tables hold no history."""
    o = f.raw("orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    li = f.raw("lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("p_partkey"))
    return li.join(f.raw("part").select("p_partkey", F.col("p_brand").alias("path")), "p_partkey").join(o, "commit").select("commit", "author", "day", "path")


_COMMITS = "cm AS (SELECT o_orderkey AS commit, o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS day, p_brand AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"
add("a_churn", lambda f: rel.churn(_commits(f)), "SELECT path, count(DISTINCT commit) AS n_commits, count(DISTINCT author) AS n_authors, min(day) AS first, max(day) AS last FROM cm GROUP BY path", _COMMITS)
add("a_coupling", lambda f: rel.coupling(_commits(f)),
    "SELECT x.path AS a, y.path AS b, count(*) AS n FROM d x JOIN d y ON x.commit = y.commit AND x.path < y.path WHERE x.commit IN (SELECT commit FROM d GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30) GROUP BY 1, 2 HAVING count(*) >= 3",
    _COMMITS, "d AS (SELECT DISTINCT commit, path FROM cm)")


def _observed(f: Facts) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = f.raw("events").select("event_type", F.lead("event_type").over(w).alias("next"))
    return e.where(F.col("next").isNotNull()).groupBy(F.col("event_type").alias("caller"), F.col("next").alias("callee")).agg(F.count(F.lit(1)).alias("n"))


_OBS = "ob AS (SELECT event_type AS caller, next AS callee, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL GROUP BY 1, 2)"
add("a_obs_edges", _observed, "SELECT * FROM ob", _OBS)
add("a_finding_levels", lambda f: f.raw("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("even")),
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0) AS even FROM events GROUP BY 1")

# -- 2.6, 2.7 windows and order -----------------------------------------------------------------------------------------

add("w_ordinal", rel.ordinals, "SELECT sid, CAST(row_number() OVER (PARTITION BY file_id, kind, qname ORDER BY start_line, end_line, sid) - 1 AS INT) AS ordinal FROM syms", _SYM)
add("w_latest", lambda f: f.files.select("file_id", "last_analyzed_at", "analysis_status"), "SELECT file_id, last_analyzed_at, analysis_status FROM files", _FILES)
add("w_topn_per_group", rel.top_per_group, "SELECT kind, CAST(rank AS INT) AS rank, sid, span FROM (SELECT kind, sid, end_line - start_line + 1 AS span, row_number() OVER (PARTITION BY kind ORDER BY span DESC NULLS LAST, sid) AS rank FROM syms) WHERE rank <= 3", _SYM)
add("o_largest", lambda f: f.symbols.where(F.col("kind").isin("function", "method", "class")).select("sid", "qname", (F.col("end_line") - F.col("start_line") + 1).alias("span")).orderBy(F.desc("span"), "qname", "sid").limit(10), "SELECT sid, qname, end_line - start_line + 1 AS span FROM syms WHERE kind IN ('function', 'method', 'class') ORDER BY span DESC, qname, sid LIMIT 10", _SYM)
add("o_page", lambda f: f.symbols.where(F.col("kind") == "class").select("sid", "qname").orderBy("qname", "sid").offset(20).limit(10), "SELECT sid, qname FROM syms WHERE kind = 'class' ORDER BY qname, sid LIMIT 10 OFFSET 20", _SYM)

# -- 2.8 sets ---------------------------------------------------------------------------------------------------------


def _static(f: Facts) -> DataFrame:
    """Edges that the price list of event types allows: every type may follow a smaller one."""
    t = f.raw("events").select("event_type").distinct()
    return t.select(F.col("event_type").alias("caller")).join(t.select(F.col("event_type").alias("callee")), F.col("caller") < F.col("callee"))


_STATIC = "st AS (SELECT a.event_type AS caller, b.event_type AS callee FROM (SELECT DISTINCT event_type FROM events) a JOIN (SELECT DISTINCT event_type FROM events) b ON a.event_type < b.event_type)"
add("x_edge_both", lambda f: _observed(f).select("caller", "callee").intersect(_static(f)), "SELECT caller, callee FROM ob INTERSECT SELECT * FROM st", _OBS, _STATIC)
add("x_edge_obs_only", lambda f: _observed(f).select("caller", "callee").exceptAll(_static(f)), "SELECT caller, callee FROM ob EXCEPT SELECT * FROM st", _OBS, _STATIC)
add("x_edge_static_only", lambda f: _static(f).join(_observed(f), ["caller", "callee"], "left_anti").join(_observed(f).select("caller"), "caller", "left_semi"), "SELECT * FROM (SELECT * FROM st EXCEPT SELECT caller, callee FROM ob) WHERE caller IN (SELECT caller FROM ob)", _OBS, _STATIC)
add("x_hash_changed", rel.hash_changes,
    """SELECT coalesce(o.file_id, n.file_id) AS file_id, CASE WHEN n.h IS NULL THEN 'removed' WHEN o.h IS NULL THEN 'added' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state
    FROM (SELECT file_id, min({'at': coalesce(last_analyzed_at, TIMESTAMP '1900-01-01'), 'h': content_hash}).h AS h FROM source_files WHERE file_id IS NOT NULL AND content_hash IS NOT NULL GROUP BY 1) o
    FULL JOIN (SELECT DISTINCT file_id, sha256(content) AS h FROM source_texts WHERE content IS NOT NULL) n ON o.file_id = n.file_id""")  # fmt: skip
add("x_facts_union", lambda f: f.symbols.select(F.lit("symbol").alias("fact"), "file_id").unionByName(f.refs_of("file_id").select(F.lit("reference").alias("fact"), "file_id")).unionByName(f.deps.select(F.lit("dependency").alias("fact"), "file_id")).groupBy("fact", "file_id").agg(F.count(F.lit(1)).alias("n")),
    "SELECT 'symbol' AS fact, file_id, count(*) AS n FROM syms GROUP BY ALL UNION ALL SELECT 'reference', file_id, count(DISTINCT reference_id) FROM rf GROUP BY ALL UNION ALL SELECT 'dependency', file_id, count(*) FROM dp GROUP BY ALL", _SYM, _REF, _DEP)

# -- 2.9 scalar functions ---------------------------------------------------------------------------------------------

add("s_component", lambda f: f.files.select("file_id", rel.component_of(F.col("path"), 2).alias("component")), "SELECT file_id, c AS component FROM comp", _FILES, _COMP)
add("s_last_segment", lambda f: f.symbols.select("sid", F.substring_index("qname", ".", -1).alias("last")), "SELECT sid, string_split(qname, '.')[-1] AS last FROM syms", _SYM)
add("s_module_name", lambda f: f.files.where(F.col("stated") == "python").select("file_id", F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), "/__init__$", ""), "/", ".").alias("module")),
    "SELECT file_id, replace(regexp_replace(regexp_replace(path, '\\.pyi?$', ''), '/__init__$', ''), '/', '.') AS module FROM files WHERE stated = 'python'", _FILES)
add("s_split_ident", lambda f: f.symbols.where(F.col("name").isNotNull()).select("sid", F.array_join(identifier_words(F.col("name")), " ").alias("words")),
    "SELECT sid, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 0), ' ') AS words FROM syms WHERE name IS NOT NULL", _SYM)
add("s_citations", lambda f: f.raw("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[([\w./-]+:\d+(?:-\d+)?)\]"), F.lit(1))).alias("citation")).groupBy("doc_id", "citation").agg(F.count(F.lit(1)).alias("n")),
    r"SELECT doc_id, citation, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[([\w./-]+:\d+(?:-\d+)?)\]', 1)) AS citation FROM documents) GROUP BY ALL")
add("s_doc_tokens", lambda f: f.raw("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([^`\n]+)`"), F.lit(1))).alias("token")).select("doc_id", "token", F.when(F.col("token").rlike("^--?[a-z]"), "option").when(F.col("token").rlike("^[A-Z][A-Z0-9_]+$"), "env").when(F.col("token").rlike(r"^[A-Za-z_][\w.:]*$"), "identifier").otherwise("other").alias("class")),
    r"SELECT doc_id, token, CASE WHEN regexp_matches(token, '^--?[a-z]') THEN 'option' WHEN regexp_matches(token, '^[A-Z][A-Z0-9_]+$') THEN 'env' WHEN regexp_matches(token, '^[A-Za-z_][\w.:]*$') THEN 'identifier' ELSE 'other' END AS class FROM (SELECT doc_id, unnest(regexp_extract_all(text, '`([^`\n]+)`', 1)) AS token FROM documents)")
add("s_hash", lambda f: f.files.select("file_id", F.substring(F.sha2(F.concat_ws("|", "project_id", "path"), 256), 1, 32).alias("derived")), "SELECT file_id, substring(sha256(concat_ws('|', project_id, path)), 1, 32) AS derived FROM files", _FILES)
add("j_doc_code", lambda f: f.raw("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([A-Za-z_]\w+)`"), F.lit(1))).alias("name")).distinct().join(f.symbols.select("name").distinct(), "name", "left_anti"),
    r"SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '`([A-Za-z_]\w+)`', 1)) AS name FROM documents) WHERE name NOT IN (SELECT name FROM syms WHERE name IS NOT NULL)", _SYM)

# -- 2.10 graph -------------------------------------------------------------------------------------------------------

add("g_callers", lambda f: f.calls().select("src", "dst").distinct().join(_seed_symbols(f).withColumnRenamed("node", "dst"), "dst", "left_semi"), "SELECT src, dst FROM calls WHERE dst IN (SELECT node FROM seed)", _SYM, _REF, _CALLS, _SEED_S)
add("g_callees", lambda f: f.refs_of("src", "dst", "kind", "status", "tname").where(F.col("kind") == "call").join(_seed_symbols(f, "src").withColumnRenamed("node", "src"), "src", "left_semi").groupBy("src", "dst", "tname", "status").agg(F.count(F.lit(1)).alias("n")),
    "SELECT src, dst, tname, status, count(*) AS n FROM rf WHERE kind = 'call' AND src IN (SELECT node FROM seed) GROUP BY ALL", _SYM, _REF, _CALLS, _SEED_SRC)
add("g_references", lambda f: f.refs.where((F.col("status") == "resolved")).join(_seed_symbols(f).withColumnRenamed("node", "dst"), "dst", "left_semi").select("reference_id", "dst", "kind", "file_id", "start_line"),
    "SELECT reference_id, dst, kind, file_id, start_line FROM rf WHERE status = 'resolved' AND dst IN (SELECT node FROM seed)", _SYM, _REF, _CALLS, _SEED_S)
add("g_deps", lambda f: f.file_edges(), "SELECT * FROM fe", _DEP, _FE)
add("g_impact", lambda f: graph.bfs(f.uses(), _seed_symbols(f), 4, reverse=True), _NEAREST, _SYM, _REF, _CALLS, _USES, _SEED_S, _reach("uses", "dst", "src", 4), recursive=True)
add("g_effects", lambda f: graph.bfs(f.calls().select("src", "dst"), _seed_symbols(f, "src"), 3).join(f.refs_of("src", "status").where(F.col("status") == "external").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node"),
    f"SELECT node, distance, n FROM ({_NEAREST}) JOIN (SELECT src, count(DISTINCT reference_id) AS n FROM rf WHERE status = 'external' GROUP BY 1) ON src = node", _SYM, _REF, _CALLS, _SEED_SRC, _reach("calls", "src", "dst", 3), recursive=True)
add("g_include_closure", lambda f: graph.bfs(f.file_edges(), _seed_files(f), reverse=True), _NEAREST, _DEP, _FE, _SEED_F, _reach("fe", "dst", "src", 40), recursive=True)
add("g_restrict", lambda f: graph.traversed(f.file_edges(), _seed_files(f), 2), f"SELECT src, dst, CAST(distance + 1 AS INT) AS distance FROM fe JOIN ({_NEAREST}) ON src = node WHERE distance < 2", _DEP, _FE, _SEED_F, _reach("fe", "src", "dst", 2), recursive=True)
add("g_focus", lambda f: graph.focus(f.file_edges(), _seed_files(f), 2),
    "SELECT node, CAST(CASE WHEN a IS NOT NULL AND (b IS NULL OR a <= b) THEN a ELSE -b END AS INT) AS distance FROM (SELECT node, min(d) AS a FROM ahead GROUP BY 1) FULL JOIN (SELECT node, min(d) AS b FROM back GROUP BY 1) USING (node)",
    _DEP, _FE, _SEED_F, _reach("fe", "src", "dst", 2).replace("reach", "ahead"), _reach("fe", "dst", "src", 2).replace("reach", "back"), recursive=True)
add("g_hierarchy", lambda f: graph.call_tree(f.calls().select("src", "dst"), _seed_symbols(f, "src"), 3),
    """SELECT array_to_string(way, ' > ') AS path, node, CAST(d AS INT) AS depth, rec AS recursive, d = 3 AND NOT rec AND node IN (SELECT src FROM calls) AS truncated FROM tree""",
    _SYM, _REF, _CALLS, _SEED_SRC, "tree AS (SELECT [node] AS way, node, 0 AS d, false AS rec FROM seed UNION ALL SELECT list_append(way, dst), dst, d + 1, list_contains(way, dst) FROM tree JOIN calls ON src = node WHERE d < 3 AND NOT rec)", recursive=True)


def _paths(f: Facts) -> DataFrame:
    """From the file with the most dependencies to the one with the most dependents."""
    e = f.file_edges()
    a = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).collect()
    b = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(1).collect()
    return graph.simple_paths(e, a[0][0] if a else "", b[0][0] if b else "", 5)


add("g_paths", _paths, "SELECT array_to_string(way, ' > ') AS path, CAST(len(way) - 1 AS INT) AS length FROM w WHERE node = (SELECT node FROM b)",
    _DEP, _FE, "a AS (SELECT src AS node FROM fe GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "b AS (SELECT dst AS node FROM fe GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "w AS (SELECT [node] AS way, node FROM a UNION ALL SELECT list_append(way, dst), dst FROM w JOIN fe ON src = node WHERE len(way) <= 5 AND node <> (SELECT node FROM b) AND NOT list_contains(way, dst))", recursive=True)


def _call_paths(f: Facts) -> DataFrame:
    """From the symbol with the most callees to the one with the most callers."""
    e = f.calls().select("src", "dst").distinct()
    a = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).collect()
    b = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(1).collect()
    return graph.simple_paths(e, a[0][0] if a else "", b[0][0] if b else "", 8)


add("g_call_paths", _call_paths, "SELECT array_to_string(way, ' > ') AS path, CAST(len(way) - 1 AS INT) AS length FROM w WHERE len(way) > 1 AND node = (SELECT node FROM b)",
    _REF, _CALLS, "a AS (SELECT src AS node FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "b AS (SELECT dst AS node FROM calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "w AS (SELECT [node] AS way, node FROM a UNION ALL SELECT list_append(way, dst), dst FROM w JOIN calls ON src = node WHERE len(way) <= 8 AND node <> (SELECT node FROM b) AND NOT list_contains(way, dst))", recursive=True)
add("g_dep_cycles", lambda f: graph.components(f.file_edges()),
    "SELECT c.a AS node, max(c.b) AS component FROM cl c JOIN cl d ON c.a = d.b AND c.b = d.a GROUP BY 1 HAVING count(*) > 1", _DEP, _FE, "cl AS (SELECT src AS a, dst AS b FROM fe UNION SELECT a, dst FROM cl JOIN fe ON b = src)", recursive=True)
add("g_layers", lambda f: graph.layers(f.file_edges()))
add("g_scc", lambda f: graph.components(f.calls().select("src", "dst")))
add("g_test_reach", lambda f: graph.bfs(f.uses(), _seed_symbols(f), 3, reverse=True).join(f.symbols.join(f.files.where(rel.test_path(F.col("path")) | (F.col("path").startswith("tools/"))).select("file_id"), "file_id", "left_semi").select(F.col("sid").alias("node")), "node", "left_semi"),
    f"SELECT node, distance FROM ({_NEAREST}) WHERE node IN (SELECT sid FROM syms JOIN files USING (file_id) WHERE starts_with(path, 'tools/') OR regexp_matches(lower(path), '(^|/)(tests?|testing|spec)/|(^|/)test_[^/]*$|_test\\.[a-z]+$|(^|/)conftest\\.py$'))",
    _FILES, _SYM, _REF, _CALLS, _USES, _SEED_S, _reach("uses", "dst", "src", 3), recursive=True)
add("g_untested", lambda f: f.symbols.where(F.col("kind").isin("function", "method")).join(graph.bfs(f.uses(), f.symbols.join(f.files.where(F.col("path").startswith("tools/")).select("file_id"), "file_id", "left_semi").select(F.col("sid").alias("node")), 3).select(F.col("node").alias("sid")), "sid", "left_anti").select("sid", "qname"),
    "SELECT sid, qname FROM syms WHERE kind IN ('function', 'method') AND sid NOT IN (SELECT node FROM reach)",
    _FILES, _SYM, _REF, _USES, "seed AS (SELECT sid AS node FROM syms JOIN files USING (file_id) WHERE starts_with(path, 'tools/'))", _reach("uses", "src", "dst", 3), recursive=True)
add("g_inherit", lambda f: f.symbols.select("sid", F.explode("base_classes").alias("base")).join(f.symbols.where(F.col("kind").isin("class", "struct")).groupBy(F.col("name").alias("base")).agg(F.count(F.lit(1)).alias("n_bases")), "base", "left"),
    "SELECT sid, base, n_bases FROM (SELECT sid, unnest(base_classes) AS base FROM syms) LEFT JOIN (SELECT name, count(*) AS n_bases FROM syms WHERE kind IN ('class', 'struct') GROUP BY 1) ON name = base", _SYM)
add("g_tree", lambda f: f.files.select("project_id", "file_id", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("directory")).groupBy("project_id", "directory").agg(F.count(F.lit(1)).alias("n_files")),
    "SELECT project_id, directory, count(*) AS n_files FROM (SELECT project_id, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda i: coalesce(array_to_string(list_slice(string_split(path, '/'), 1, i), '/'), ''))) AS directory FROM files WHERE path IS NOT NULL) GROUP BY ALL", _FILES)
_ROLES = [("cmd", 0), ("app", 1), ("engine", 2), ("core", 2), ("lib", 3), ("internal", 3)]
add("g_violations", lambda f: _violations(f),
    "SELECT src, dst FROM fe JOIN lv a ON fe.src = a.file_id JOIN lv b ON fe.dst = b.file_id WHERE a.v > b.v", _FILES, _DEP, _FE, "lv AS (SELECT file_id, CASE split_part(path, '/', 1) " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in _ROLES) + " END AS v FROM files)")


def _violations(f: Facts) -> DataFrame:
    """Dependencies from a lower layer to a higher one, by the first directory."""
    role = F.try_element_at(F.create_map(*[F.lit(x) for p in _ROLES for x in p]), F.split("path", "/")[0])
    lv = f.files.select("file_id", role.alias("v")).where(F.col("v").isNotNull())
    e = f.file_edges().join(lv.select(F.col("file_id").alias("src"), F.col("v").alias("a")), "src").join(lv.select(F.col("file_id").alias("dst"), F.col("v").alias("b")), "dst")
    return e.where(F.col("a") > F.col("b")).select("src", "dst")


# -- 2.13, 2.14 composites and retrieval ----------------------------------------------------------------------------------

add("u_unused", rel.unused,
    r"""SELECT sid, qname, CASE WHEN name IN (SELECT regexp_extract(tname, '([^.:/>\-]+)$', 1) FROM rf WHERE status IN ('unresolved', 'ambiguous') AND length(regexp_extract(tname, '([^.:/>\-]+)$', 1)) > 0) THEN 'maybe' WHEN len(decorators) > 0 THEN 'decorated' ELSE 'unused' END AS verdict
    FROM syms JOIN files USING (file_id) WHERE kind IN ('function', 'method', 'class') AND NOT regexp_matches(lower(path), '(^|/)(tests?|testing|spec)/|(^|/)test_[^/]*$|_test\.[a-z]+$|(^|/)conftest\.py$') AND NOT regexp_matches(name, '^__.*__$') AND name IS DISTINCT FROM 'main'
    AND sid NOT IN (SELECT dst FROM rf WHERE status = 'resolved' AND src <> dst AND dst IS NOT NULL)""", _FILES, _SYM, _REF)  # fmt: skip
add("u_freshness", rel.freshness, "SELECT f.file_id, CASE WHEN content_hash IS NULL THEN 'unanalyzed' WHEN h IS NULL THEN 'missing' WHEN h = content_hash THEN 'fresh' ELSE 'stale' END AS state FROM files f LEFT JOIN (SELECT file_id, max(sha256(content)) AS h FROM source_texts GROUP BY 1) t USING (file_id)", _FILES)
add("u_coverage", lambda f: f.files.groupBy("stated").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.coalesce(F.col("analysis_status") != "analyzed", F.lit(True))).alias("n_open")), "SELECT stated, count(*) AS n_files, count(*) FILTER (analysis_status IS DISTINCT FROM 'analyzed') AS n_open FROM files GROUP BY stated", _FILES)
add("u_boundary_light", lambda f: f.symbols.where((F.col("name") == "main") | F.coalesce("is_async", F.lit(False)) | F.array_contains("decorators", "cached")).select("sid", F.when(F.col("name") == "main", "entry").when(F.col("is_async"), "async").otherwise("cache").alias("boundary")),
    "SELECT sid, CASE WHEN name = 'main' THEN 'entry' WHEN is_async THEN 'async' ELSE 'cache' END AS boundary FROM syms WHERE name = 'main' OR coalesce(is_async, false) OR list_contains(decorators, 'cached')", _SYM)
_QUESTIONS = [(1, "clip the ledger buffer"), (2, "where is the lattice index rebuilt"), (3, "heartbeat per channel gives up after silent intervals")]


def _ranked(f: Facts, top: int | None, body: bool = False) -> DataFrame:
    return retrieval.bm25(retrieval.symbol_documents(f), f.spark.createDataFrame(_QUESTIONS, "qid int, question string"), top, retrieval.symbol_bodies(f) if body else None)


_T = lambda c: f"unnest(list_filter(regexp_extract_all(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda w: length(w) >= 2))"
_BM = [
    _FILES, _SYM,
    "docs AS (SELECT sid AS doc, name, path, coalesce(summary, '') AS t FROM syms JOIN files USING (file_id) WHERE kind IN ('function', 'method', 'class', 'struct'))",
    f"post AS (SELECT doc, {_T('name')} AS term, 4.0 AS w FROM docs UNION ALL SELECT doc, {_T('path')}, 1.5 FROM docs UNION ALL SELECT doc, {_T('t')}, 2.0 FROM docs)",
    f"q AS (SELECT DISTINCT qid, term FROM (SELECT qid, {_T('question')} AS term FROM (VALUES {', '.join(str(x) for x in _QUESTIONS)}) v(qid, question)))",
    "per AS (SELECT doc, term, CAST(sum(w) AS DOUBLE) AS w FROM post WHERE term IN (SELECT term FROM q) GROUP BY 1, 2)",
    "idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM per GROUP BY 1)",
    "sc AS (SELECT qid, doc, round(sum(idf * w * 2.2 / (w + 1.2)) * (1 + 0.15 * (count(*) - 1)), 6) AS score, count(*) AS matched FROM per JOIN idf USING (term) JOIN q USING (term) GROUP BY 1, 2)",
]
add("t_bm25f", lambda f: _ranked(f, 4), "SELECT qid, doc, score, matched FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM sc) WHERE r <= 4", *_BM)
add("t_scores", lambda f: _ranked(f, None).select("qid", "doc", "matched"), "SELECT qid, doc, matched FROM sc", *_BM)

# the same with the body as a field; the SQL above stays without it
_IN_BODY = [
    "tx AS (SELECT DISTINCT file_id, string_split_regex(content, '\\r\\n|\\n') AS x FROM files JOIN source_texts USING (file_id) WHERE content IS NOT NULL AND sha256(content) = content_hash)",
    "own AS (SELECT DISTINCT sid AS doc, file_id, unnest(range(greatest(start_line, 1), least(end_line, len(x)) + 1)) AS line FROM syms JOIN files USING (file_id) JOIN tx USING (file_id) WHERE kind IN ('function', 'method', 'class', 'struct') AND start_line IS NOT NULL AND end_line IS NOT NULL)",
    f"bt AS (SELECT doc, {_T('x[line]')} AS term FROM own JOIN tx USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM syms k WHERE k.pid = doc AND line BETWEEN k.start_line AND k.end_line))",
    "bl AS (SELECT doc, count(*) AS length FROM bt GROUP BY 1)",
    "tf AS (SELECT doc, term, count(*) AS k FROM bt WHERE term IN (SELECT term FROM q) GROUP BY 1, 2)",
    "per AS (SELECT doc, term, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT doc, term, CAST(w AS DOUBLE) AS w FROM post WHERE term IN (SELECT term FROM q) UNION ALL SELECT doc, term, k / (0.25 + 0.75 * length / greatest((SELECT count(*) FROM bt) / (SELECT count(*) FROM docs), 1.0)) FROM tf JOIN bl USING (doc)) GROUP BY 1, 2)",
]
_BMB = [*_BM[:-3], *_IN_BODY, *_BM[-2:]]
add("t_bm25f_body", lambda f: _ranked(f, 4, True), "SELECT qid, doc, score, matched FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM sc) WHERE r <= 4", *_BMB)
add("t_scores_body", lambda f: _ranked(f, None, True).select("qid", "doc", "matched"), "SELECT qid, doc, matched FROM sc", *_BMB)

# -- 2.1, 2.11, 2.12 extraction, resolution and analyses of functions: no SQL, tested on small sources ----------------------


def _code(what: str, *languages: str):
    return lambda f: facts_of(f.raw("source_files"), f.raw("source_texts"), what, *([languages] if languages else []))


add("src_symbols", _code("symbols"))
add("src_refs", _code("refs"))
add("src_deps", _code("deps"))
add("p_flow", _code("flows"))
add("p_vars", _code("variables", "python"))
add("p_risks_py", lambda f: _code("findings", "python")(f).where(~F.col("rule").startswith("boundary") & ~F.col("rule").isin("env-read", "env-write", "cli-option")))
add("p_config", lambda f: _code("findings", "python")(f).where(F.col("rule").isin("env-read", "env-write", "cli-option")))
add("p_boundaries", lambda f: _code("findings", "python")(f).where(F.col("rule").startswith("boundary")))


def _resolved(f: Facts) -> DataFrame:
    s = _code("symbols")(f).select(F.substring(F.sha2(F.concat_ws("|", "file_id", "kind", "qname", F.col("start_line")), 256), 1, 32).alias("sid"), "qname", "name", "kind", "decorators")
    return resolve.resolve_references(_code("refs")(f), s)


add("r_name", _resolved)
add("r_dep", lambda f: resolve.resolve_dependencies(_code("deps")(f), f.files.select("file_id", "path")))
add("snk_resolution", lambda f: resolve.changed(f.deps.select("dependency_id", "target_file_id", "status"), f.deps.select("dependency_id", F.when(F.col("confidence") == "confirmed", F.col("target_file_id")).alias("target_file_id"), "status"), "dependency_id", ["target_file_id", "status"]),
    "SELECT dependency_id, CAST(NULL AS VARCHAR) AS target_file_id, status FROM dp WHERE confidence IS DISTINCT FROM 'confirmed' AND target_file_id IS NOT NULL", _DEP)

# -- further operators ------------------------------------------------------------------------------------------------

add("f_resolve_one", lambda f: more.at_line(f, "name_of", 10), "SELECT sid, qname, kind FROM b WHERE kind NOT LIKE '%declaration' OR (SELECT count(*) FROM b WHERE kind NOT LIKE '%declaration') = 0", _SYM, "b AS (SELECT * FROM syms WHERE name = 'name_of' AND 10 BETWEEN start_line AND end_line)")
add("f_suggest", lambda f: more.suggest(f, "clip_lattise"),
    "SELECT name, round(1 - levenshtein(name, 'clip_lattise') / greatest(length(name), 12), 6) AS similarity FROM (SELECT DISTINCT name FROM syms WHERE name IS NOT NULL) WHERE round(1 - levenshtein(name, 'clip_lattise') / greatest(length(name), 12), 6) >= 0.6 ORDER BY 2 DESC, 1 LIMIT 3", _SYM)
_NORM = """CASE WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN w LIKE '%ies' AND length(w) >= 6 THEN w[:-4] || 'y' WHEN w LIKE '%ied' AND length(w) >= 6 THEN w[:-4] || 'y' WHEN w LIKE '%sses' AND length(w) >= 7 THEN w[:-3]
  WHEN w LIKE '%ing' AND length(w) >= 7 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) >= 6 THEN w[:-3] WHEN w LIKE '%es' AND length(w) >= 6 THEN w[:-3] WHEN w LIKE '%s' AND length(w) >= 4 THEN w[:-2] ELSE w END"""
_STOP = ", ".join(f"'{w}'" for w in more.STOP_WORDS)
_WORDS = f"wd AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS w FROM syms) WHERE length(w) >= 2 AND w NOT IN ({_STOP}))"
add("s_terms", lambda f: f.symbols.select("sid", F.explode(more.terms(F.col("summary"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS w FROM syms) WHERE length(w) >= 2 AND w NOT IN ({_STOP}) GROUP BY w", _SYM)
add("s_normalize", lambda f: f.symbols.select(F.explode(F.array_distinct(more.terms(F.col("summary")))).alias("word")).distinct().select("word", more.normalize(F.col("word")).alias("stem")), f"SELECT w AS word, {_NORM} AS stem FROM wd", _SYM, _WORDS)
_ROLE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in more.ROLES.items())
add("s_role", lambda f: f.files.where(F.col("path").isNotNull()).select("file_id", more.role(F.col("path")).alias("role")),
    f"SELECT file_id, list_filter(list_transform(list_reverse(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)), lambda x: CASE x {_ROLE} END), lambda r: r IS NOT NULL)[1] AS role FROM files WHERE path IS NOT NULL", _FILES)
_CD = lambda d: f"count(DISTINCT CASE WHEN len(string_split(path, '/')) < 2 THEN '(root)' ELSE array_to_string(list_slice(string_split(path, '/'), 1, least({d}, len(string_split(path, '/')) - 1)), '/') END)"
add("s_auto_depth", more.auto_depth, "SELECT CASE " + " ".join(f"WHEN {_CD(d)} >= 5 THEN {d}" for d in range(1, 6)) + " ELSE 5 END AS depth FROM files WHERE path IS NOT NULL", _FILES)
add("s_mentions", lambda f: f.raw("documents").where(more.mentions(F.col("text"), "LATTICE")).select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])LATTICE($|[^A-Za-z0-9_])')")
add("s_marker", lambda f: rel.grep(f, r"(//|#|;).*\b(TODO|FIXME|XXX|HACK)\b", True).select("file_id", "line"), r"SELECT file_id, CAST(line AS INT) AS line FROM lines WHERE regexp_matches(text, '(?i)(//|#|;).*\b(TODO|FIXME|XXX|HACK)\b')", _FILES, _LINES)
add("a_df", lambda f: f.symbols.select("sid", F.explode(F.array_distinct(more.terms(F.col("summary")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")),
    f"SELECT w AS term, count(*) AS df FROM (SELECT DISTINCT sid, w FROM (SELECT sid, unnest(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS w FROM syms) WHERE length(w) >= 2 AND w NOT IN ({_STOP})) GROUP BY w", _SYM)
add("a_env_used", more.externals_used, "SELECT string_split_regex(tname, '[./]')[1] AS name, count(*) AS n_imports, count(DISTINCT file_id) AS n_files FROM dp WHERE status = 'external' AND length(tname) > 0 GROUP BY 1", _DEP)
add("x_decl_used", lambda f: more.declared_and_used(more.externals_used(f), f.raw("library_symbols").select(F.col("library").alias("name"))),
    "SELECT name, 'undeclared' AS state FROM (SELECT name FROM u EXCEPT SELECT name FROM d) UNION ALL SELECT name, 'unused_declared' FROM (SELECT name FROM d EXCEPT SELECT name FROM u)",
    _DEP, "u AS (SELECT DISTINCT replace(lower(string_split_regex(tname, '[./]')[1]), '_', '-') AS name FROM dp WHERE status = 'external' AND length(tname) > 0)", "d AS (SELECT DISTINCT replace(lower(library), '_', '-') AS name FROM library_symbols)")
add("a_effect_unres", lambda f: f.refs_of("src", "kind", "status").where((F.col("kind") == "call") & F.col("status").isin("unresolved", "ambiguous")).join(graph.bfs(f.calls().select("src", "dst"), _seed_symbols(f, "src"), 3).select(F.col("node").alias("src")), "src", "left_semi").groupBy("status").agg(F.count_distinct("reference_id").alias("n")),
    "SELECT status, count(DISTINCT reference_id) AS n FROM rf WHERE kind = 'call' AND status IN ('unresolved', 'ambiguous') AND src IN (SELECT node FROM reach) GROUP BY status", _SYM, _REF, _CALLS, _SEED_SRC, _reach("calls", "src", "dst", 3), recursive=True)
add("j_calls_by_line", lambda f: f.refs_of("src", "kind", "start_line").where(F.col("kind") == "call").groupBy("src", "start_line").agg(F.count(F.lit(1)).alias("n_calls")), "SELECT src, start_line, count(*) AS n_calls FROM rf WHERE kind = 'call' GROUP BY ALL", _REF)
add("o_ref_order", rel.references_in_order, "SELECT reference_id, file_id, start_line, tname FROM rf ORDER BY file_id, start_line, tname NULLS FIRST, reference_id LIMIT 100", _REF)
add("g_call", more.call_graph,
    "SELECT src, CASE WHEN status = 'resolved' AND dst IS NOT NULL THEN dst WHEN status = 'external' THEN 'external:' || coalesce(tname, '') ELSE 'open:' || coalesce(src, '') || ':' || coalesce(tname, '') END AS dst, CASE WHEN status <> 'resolved' THEN status ELSE confidence END AS style, count(*) AS n FROM rf WHERE kind = 'call' GROUP BY ALL", _REF)
_PARENT = f"SELECT r.node, r.distance, (SELECT min(c.src) FROM calls c JOIN ({_NEAREST}) p ON c.src = p.node AND p.distance = r.distance - 1 WHERE c.dst = r.node) AS parent FROM ({_NEAREST}) r"
add("w_first_seen", lambda f: more.first_parents(f.calls().select("src", "dst").distinct(), _seed_symbols(f, "src"), 4), _PARENT, _SYM, _REF, _CALLS, _SEED_SRC, _reach("calls", "src", "dst", 4), recursive=True)
add("g_extract", lambda f: more.extracted(f.calls().select("src", "dst").distinct(), _seed_symbols(f, "src")),
    f"SELECT *, CAST(row_number() OVER (ORDER BY distance, node) AS INT) AS rank, (SELECT count(DISTINCT node) FROM reach) > 30 AS truncated FROM ({_PARENT}) ORDER BY distance, node LIMIT 30", _SYM, _REF, _CALLS, _SEED_SRC, _reach("calls", "src", "dst", 5), recursive=True)
add("g_bases_closure", more.base_names, "SELECT name, base, CAST(min(d) AS INT) AS distance FROM cl GROUP BY 1, 2", _SYM,
    "bs AS (SELECT DISTINCT name, unnest(base_classes) AS base FROM syms WHERE kind IN ('class', 'struct') AND name IS NOT NULL)", "cl AS (SELECT name, base, 1 AS d FROM bs UNION SELECT c.name, b.base, d + 1 FROM cl c JOIN bs b ON c.base = b.name WHERE d < 10)", recursive=True)
add("u_show", lambda f: more.shown(f, f.symbols.where(F.col("name") == "name_of").select("sid")),
    "SELECT sid, CAST(line AS INT) AS line, regexp_replace(x[line], chr(13) || '$', '') AS text, line BETWEEN start_line AND end_line AS inside FROM (SELECT sid, start_line, end_line, x, unnest(range(greatest(start_line - 2, 1), least(end_line + 2, len(x)) + 1)) AS line FROM (SELECT sid, start_line, end_line, string_split(content, chr(10)) AS x FROM syms JOIN source_texts USING (file_id) WHERE name = 'name_of' AND content IS NOT NULL))", _SYM)
_FRESH = "fr AS (SELECT f.file_id, f.project_id, f.path, n_lines, CASE WHEN content_hash IS NULL THEN 'unanalyzed' WHEN h IS NULL THEN 'missing' WHEN h = content_hash THEN 'fresh' ELSE 'stale' END AS state FROM files f LEFT JOIN (SELECT file_id, max(sha256(content)) AS h, max(len(string_split(content, chr(10)))) AS n_lines FROM source_texts GROUP BY 1) t USING (file_id))"
add("c_validate", more.citations,
    """SELECT doc_id, c.path, c.a AS start, c.b AS "end", CASE WHEN k.state IS NULL THEN 'not_found' WHEN k.state = 'stale' THEN 'stale' WHEN c.a < 1 OR c.b < c.a OR c.b > coalesce(n_lines, 0) OR c.a IS NULL OR c.b IS NULL THEN 'out_of_range' ELSE 'verified' END AS status
    FROM c LEFT JOIN (SELECT project_id, path, max(state) AS state, max(n_lines) AS n_lines FROM fr GROUP BY 1, 2) k ON c.project_id = k.project_id AND c.path = k.path""",
    _FILES, _FRESH, r"c AS (SELECT DISTINCT doc_id, project_id, regexp_extract(c, '^(.*):', 1) AS path, TRY_CAST(regexp_extract(c, ':(\d+)', 1) AS INT) AS a, TRY_CAST(coalesce(nullif(regexp_extract(c, '-(\d+)$', 1), ''), regexp_extract(c, ':(\d+)', 1)) AS INT) AS b FROM (SELECT doc_id, project_id, unnest(regexp_extract_all(text, '\[([\w./-]+:\d+(?:-\d+)?)\]', 1)) AS c FROM documents))")
_MENTION = "mn AS (SELECT doc_id, k, unnest(regexp_extract_all(line, '`([A-Za-z_]\\w{3,})`', 1)) AS name FROM (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))"
add("u_doc_mentions", more.doc_mentions,
    "SELECT name, doc_id, CAST(line AS INT) AS line FROM (SELECT name, doc_id, min(k) AS line, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS r FROM mn WHERE name IN (SELECT name FROM syms WHERE kind IN ('function', 'method', 'class', 'struct')) GROUP BY 1, 2) WHERE r <= 5", _SYM, _MENTION)
add("c_infer_edges", more.inferred_edges,
    "SELECT a, b, count(*) AS n FROM (SELECT sid AS a, lead(sid) OVER (PARTITION BY doc_id, k ORDER BY sid) AS b FROM (SELECT DISTINCT doc_id, k, sid FROM mn JOIN (SELECT name, min(sid) AS sid FROM syms WHERE kind IN ('function', 'method', 'class', 'struct') GROUP BY 1 HAVING count(*) = 1) USING (name))) WHERE b IS NOT NULL GROUP BY 1, 2", _SYM, _MENTION)


def _expected(f: Facts) -> DataFrame:
    """For each question, the definitions whose summary holds one of its words as written."""
    wanted = f.spark.createDataFrame([(1, "ledger"), (2, "lattice"), (3, "heartbeat")], "qid int, word string")
    s = f.symbols.where(F.col("kind").isin("function", "method", "class", "struct")).select(F.col("sid").alias("doc"), F.explode(F.array_distinct(more.terms(F.col("summary")))).alias("word"))
    return s.join(wanted, "word").select("qid", "doc")


add("t_eval", lambda f: more.evaluation(_ranked(f, None), _expected(f)),
    "SELECT count(*) AS n, round(avg(CASE WHEN r <= 4 THEN 1 ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (SELECT DISTINCT qid FROM ex) LEFT JOIN (SELECT qid, min(r) AS r FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM sc) JOIN ex USING (qid, doc) GROUP BY 1) USING (qid)",
    *_BM, "ex AS (SELECT DISTINCT qid, sid AS doc FROM (SELECT sid, unnest(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS word FROM syms WHERE kind IN ('function', 'method', 'class', 'struct')) JOIN (VALUES (1, 'ledger'), (2, 'lattice'), (3, 'heartbeat')) v(qid, word) USING (word))")
add("t_eval_body", lambda f: more.evaluation(_ranked(f, None, True), _expected(f)),
    "SELECT count(*) AS n, round(avg(CASE WHEN r <= 4 THEN 1 ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (SELECT DISTINCT qid FROM ex) LEFT JOIN (SELECT qid, min(r) AS r FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM sc) JOIN ex USING (qid, doc) GROUP BY 1) USING (qid)",
    *_BMB, "ex AS (SELECT DISTINCT qid, sid AS doc FROM (SELECT sid, unnest(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS word FROM syms WHERE kind IN ('function', 'method', 'class', 'struct')) JOIN (VALUES (1, 'ledger'), (2, 'lattice'), (3, 'heartbeat')) v(qid, word) USING (word))")

# -- analyses across functions: no SQL, tested on small sources --------------------------------------------------------------

add("p_class_state", _code("states", "python"))
add("g_cfg_py", _code("blocks", "python"))
add("p_exceptions", lambda f: functions.exception_flow(_code("exceptions", "python")(f), _code("refs", "python")(f).where(F.col("kind") == "call").select("source", "target", "line")))
add("p_trace", lambda f: functions.trace(_code("variables", "python")(f), _seed_values(f), 4))
add("p_upstream", lambda f: functions.trace(_code("variables", "python")(f), _seed_values(f), 4, True))
add("p_fields", lambda f: functions.field_uses(_code("fields", "c", "cpp", "go")(f)))
add("p_macros", lambda f: functions.macro_uses(_code("macros", "c", "cpp")(f), _code("refs", "c", "cpp")(f)))
add("p_risks_c", _code("findings", "c", "cpp", "go"))
add("p_risks_el", _code("findings", "elisp"))


def _seed_values(f: Facts) -> DataFrame:
    """The first parameters, self and cls aside, of all functions."""
    v = _code("variables", "python")(f)
    p = v.where((F.col("what") == "def") & (F.col("how") == "param") & ~F.col("name").isin("self", "cls") & F.col("to").isin("0", "1"))
    return p.groupBy("qname").agg(F.min_by("name", "to").alias("name")).select(F.concat_ws(":", "qname", "name").alias("node"))
