"""Queries of the resolver's tiers over the fact tables, with equivalent SQL where the tables hold the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.facts import Facts
from factloom.operators import tiers
from factloom.plans.reference import _CALLS, _DEP, _FE, _FILES, _REF, _SYM, _code, add
from factloom.session import Scratch

_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def _dir(path) -> F.Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _python(f: Facts) -> DataFrame:
    s = _code("symbols", "python")(f).select(F.substring(F.sha2(F.concat_ws("|", "file_id", "kind", "qname", F.col("start_line")), 256), 1, 32).alias("sid"), "qname", "name", "kind", "decorators")
    return tiers.resolve_keys(_code("keys", "python")(f), s, _code("exports", "python")(f))


add("r_python", _python)


def _bases(f: Facts) -> DataFrame:
    """(cls, position, base) by names that one class or struct of the project has; other names stand for themselves."""
    c = f.symbols.where(F.col("kind").isin("class", "struct")).join(f.files.select("file_id", "project_id"), "file_id")
    one = c.groupBy("project_id", "name").agg(F.min("sid").alias("base"), F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select("project_id", "name", "base")
    return c.select("project_id", F.col("sid").alias("cls"), F.posexplode("base_classes").alias("position", "name")).join(one, ["project_id", "name"], "left").select("cls", "position", F.coalesce("base", F.concat(F.lit("external:"), "name")).alias("base"))


add("g_linearize", lambda f: tiers.linearize(_bases(f), _bases(f).select("cls"), Scratch(f.spark, "order")).select("cls", "base", "distance", F.concat_ws(",", F.col("way").cast("array<string>")).alias("way")),
    "SELECT cls, base, CAST(min(d) AS INT) AS distance, array_to_string(arg_min(way, (d, way)), ',') AS way FROM w GROUP BY cls, base",
    _FILES, _SYM, "cs AS (SELECT s.*, project_id FROM syms s JOIN files USING (file_id) WHERE s.kind IN ('class', 'struct'))", "one AS (SELECT project_id, name, min(sid) AS base FROM cs GROUP BY 1, 2 HAVING count(*) = 1)",
    "bs AS (SELECT cls, position, coalesce(base, 'external:' || name) AS base FROM (SELECT project_id, sid AS cls, unnest(base_classes) AS name, unnest(range(0, len(base_classes))) AS position FROM cs) LEFT JOIN one USING (project_id, name))",
    "w AS (SELECT DISTINCT cls, cls AS base, 0 AS d, CAST([] AS BIGINT[]) AS way, [cls] AS seen FROM bs UNION ALL SELECT w.cls, b.base, d + 1, list_append(way, b.position), list_append(seen, b.base) FROM w JOIN bs b ON w.base = b.cls WHERE NOT list_contains(seen, b.base))", recursive=True)


def _go_calls(f: Facts) -> DataFrame:
    go = f.files.where(F.col("stated") == "go").select("file_id")
    r = f.refs_of("file_id", "tname", "kind").where((F.col("kind") == "call") & F.contains("tname", F.lit("."))).join(go, "file_id", "left_semi")
    return r.select(F.col("reference_id").alias("call"), "file_id", F.substring_index("tname", ".", -1).alias("name")).distinct()


def _go(f: Facts) -> DataFrame:
    go = f.files.where(F.col("stated") == "go").select("file_id", _dir("path").alias("package"))
    methods = f.symbols.where(F.col("kind").isin("method", "function")).join(go, "file_id").select("sid", "name", "package")
    near = f.file_edges().join(go.select(F.col("file_id").alias("dst"), "package"), "dst").select(F.col("src").alias("file_id"), "package")
    return tiers.go_methods(_go_calls(f), methods, go.unionByName(near))


_GO = [
    "go AS (SELECT file_id, " + _DIR + " AS package FROM files WHERE stated = 'go')",
    "cl AS (SELECT DISTINCT reference_id AS call, file_id, string_split(tname, '.')[-1] AS name FROM rf WHERE kind = 'call' AND contains(tname, '.') AND file_id IN (SELECT file_id FROM go))",
    "mt AS (SELECT sid, name, package FROM syms JOIN go USING (file_id) WHERE kind IN ('method', 'function'))",
    "rc AS (SELECT file_id, package FROM go UNION SELECT src, package FROM fe JOIN go ON dst = go.file_id)",
    "nr AS (SELECT file_id, name, count(DISTINCT sid) AS n, min(sid) AS hit FROM mt JOIN rc USING (package) GROUP BY ALL)",
]
add("r_go", _go, "SELECT call, CASE WHEN n = 1 THEN hit END AS target, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' WHEN name IN (SELECT name FROM mt WHERE name IS NOT NULL) THEN 'unresolved' ELSE 'external' END AS status FROM cl LEFT JOIN nr USING (file_id, name)", _FILES, _SYM, _REF, _DEP, _FE, *_GO)


def _c(f: Facts) -> DataFrame:
    """Calls in C and C++ whose target is known, resolved again by the USR of that target; external ones count as declared in a system header."""
    c = f.files.where(F.col("stated").isin("c", "cpp")).select("file_id")
    r = f.refs_of("file_id", "dst", "kind", "status").where((F.col("kind") == "call") & F.col("dst").isNotNull()).join(c, "file_id", "left_semi")
    r = r.join(f.symbols.select(F.col("sid").alias("dst"), "usr"), "dst").where(F.length("usr") > 0)
    calls = r.select(F.col("reference_id").alias("call"), "usr", (F.col("status") == "external").alias("system"), F.lit(False).alias("virtual")).distinct()
    return tiers.by_usr(calls, f.symbols.select("sid", "usr", "kind"))


add("r_c", _c,
    """SELECT call, CASE WHEN status = 'resolved' THEN coalesce(d, p) END AS target, status, CASE WHEN status = 'resolved' THEN 'confirmed' ELSE 'inferred' END AS confidence FROM (SELECT *, CASE WHEN system THEN CASE WHEN n > 0 THEN 'ambiguous' ELSE 'external' END
    WHEN n > 1 THEN 'ambiguous' WHEN n = 1 OR p IS NOT NULL THEN 'resolved' ELSE 'external' END AS status FROM cl JOIN (SELECT usr, count(*) FILTER (kind IN ('function', 'method')) AS n, min(sid) FILTER (kind IN ('function', 'method')) AS d,
    min(sid) FILTER (kind IN ('function_declaration', 'method_declaration')) AS p FROM syms WHERE length(usr) > 0 GROUP BY usr) USING (usr))""",
    _FILES, _SYM, _REF, "cl AS (SELECT DISTINCT reference_id AS call, usr, status = 'external' AS system FROM rf JOIN syms ON dst = sid WHERE rf.kind = 'call' AND length(usr) > 0 AND rf.file_id IN (SELECT file_id FROM files WHERE stated IN ('c', 'cpp')))")


def _el(f: Facts) -> DataFrame:
    el = f.files.where(F.col("stated") == "elisp").select("file_id")
    calls = f.refs_of("file_id", "tname", "kind").where((F.col("kind") == "call") & (F.length("tname") > 0)).join(el, "file_id", "left_semi").select(F.col("reference_id").alias("call"), F.col("tname").alias("name")).distinct()
    return tiers.by_global_name(calls, f.symbols.where(F.col("kind").isin("function", "macro")).join(el, "file_id", "left_semi").select("sid", "name"))


add("r_el", _el,
    "SELECT call, CASE WHEN n = 1 THEN hit END AS target, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'external' END AS status FROM (SELECT DISTINCT reference_id AS call, tname AS name FROM rf WHERE kind = 'call' AND length(tname) > 0 AND file_id IN (SELECT file_id FROM el)) LEFT JOIN (SELECT name, count(*) AS n, min(sid) AS hit FROM syms WHERE kind IN ('function', 'macro') AND file_id IN (SELECT file_id FROM el) GROUP BY name) USING (name)",
    _FILES, _SYM, _REF, "el AS (SELECT file_id FROM files WHERE stated = 'elisp')")


def _tails(path: F.Column) -> F.Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _dep_go(f: Facts) -> DataFrame:
    """Go imports: the directory that ends in the import path stands for the package, its first file for the directory; else external."""
    go = f.files.where((F.col("stated") == "go") & F.contains("path", F.lit("/"))).groupBy("project_id", _dir("path").alias("package")).agg(F.min("path").alias("first"))
    ends = go.select("project_id", F.explode(_tails(F.col("package"))).alias("tname"), "package", "first").groupBy("project_id", "tname").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("hit"))
    d = f.deps.where(F.length("tname") > 0).join(f.files.where(F.col("stated") == "go").select("file_id", "project_id"), "file_id").select("dependency_id", "project_id", "tname")
    j = d.join(ends, ["project_id", "tname"], "left")
    return j.select("dependency_id", F.when(F.col("n") == 1, F.col("hit")).alias("target_path"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("external").alias("status"))


_STATE = "CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'external' END AS status"
add("r_dep_go", _dep_go, f"SELECT dependency_id, CASE WHEN n = 1 THEN hit END AS target_path, {_STATE} FROM d LEFT JOIN e ON d.project_id = e.project_id AND d.tname = e.tname",
    _FILES, _DEP, f"pk AS (SELECT project_id, {_DIR} AS package, min(path) AS first FROM files WHERE stated = 'go' AND contains(path, '/') GROUP BY 1, 2)",
    "tl AS (SELECT project_id, first, string_split(package, '/') AS p, unnest(range(1, len(string_split(package, '/')) + 1)) AS i FROM pk)",
    "e AS (SELECT project_id, array_to_string(list_slice(p, i, len(p)), '/') AS tname, count(*) AS n, min(first) AS hit FROM tl GROUP BY 1, 2)",
    "d AS (SELECT dependency_id, project_id, tname FROM dp JOIN files f ON dp.file_id = f.file_id WHERE stated = 'go' AND length(tname) > 0)")


def _dep_el(f: Facts) -> DataFrame:
    """Emacs Lisp features: the file of that name in the project, if it is the only one."""
    el = f.files.where(F.col("stated") == "elisp").select("project_id", "path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("tname"))
    one = el.groupBy("project_id", "tname").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("hit"))
    d = f.deps.where(F.length("tname") > 0).join(f.files.where(F.col("stated") == "elisp").select("file_id", "project_id"), "file_id").select("dependency_id", "project_id", "tname")
    j = d.join(one, ["project_id", "tname"], "left")
    return j.select("dependency_id", F.when(F.col("n") == 1, F.col("hit")).alias("target_path"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("external").alias("status"))


add("r_dep_el", _dep_el, f"SELECT dependency_id, CASE WHEN n = 1 THEN hit END AS target_path, {_STATE} FROM d LEFT JOIN e ON d.project_id = e.project_id AND d.tname = e.tname",
    _FILES, _DEP, "e AS (SELECT project_id, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS tname, count(*) AS n, min(path) AS hit FROM files WHERE stated = 'elisp' GROUP BY 1, 2)",
    "d AS (SELECT dependency_id, project_id, tname FROM dp JOIN files f ON dp.file_id = f.file_id WHERE stated = 'elisp' AND length(tname) > 0)")
