"""Queries of the general problems: hierarchies (3) and heavy keys (5)."""

from __future__ import annotations

from factloom.operators import hierarchy, keyed
from factloom.sources.tables import load

_BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)||chr(12288)"

QUERIES = {
    "p3_found": lambda s, d: hierarchy.circular(load(s, d, "symbols")),
    "p3_hierarchy": lambda s, d: hierarchy.hierarchy(load(s, d, "symbols")),
    "p3_descendants": lambda s, d: hierarchy.descendants(load(s, d, "symbols")),
    "p5_found": lambda s, d: keyed.heavy_keys(load(s, d, "refs")).select("key_field", "key_value"),
    "p5_keys": lambda s, d: keyed.key_profile(load(s, d, "refs")),
}

_NODES = f"""
n0 AS (SELECT symbol_id, nullif(lower(trim(symbol_id, {_BLANKS})), '') AS sid, nullif(lower(trim(parent_symbol_id, {_BLANKS})), '') AS pid,
  qualified_name, name FROM symbols),
n1 AS (SELECT sid, min(symbol_id) AS symbol_id, min(pid) AS pid, min(qualified_name) AS qualified_name, min(name) AS name FROM n0 WHERE sid IS NOT NULL GROUP BY sid),
nodes AS (SELECT a.sid, a.symbol_id, b.sid AS pid, coalesce(CASE WHEN length(trim(a.qualified_name)) > 0 THEN a.qualified_name END,
  CASE WHEN length(trim(a.name)) > 0 THEN a.name END, a.symbol_id) AS label FROM n1 a LEFT JOIN n1 b ON a.pid = b.sid),
tree AS (SELECT sid, sid AS root, CAST(0 AS BIGINT) AS depth, label AS path FROM nodes WHERE pid IS NULL
  UNION ALL SELECT n.sid, t.root, t.depth + 1, t.path || ' > ' || n.label FROM tree t JOIN nodes n ON n.pid = t.sid)"""

_KEYED = f"""keyed AS (SELECT reference_id, file_id, source_symbol_id,
  CASE WHEN target_symbol_id IS NOT NULL THEN 'target_symbol_id' WHEN length(trim(target_name, {_BLANKS})) > 0 THEN 'target_name' END AS key_field,
  CASE WHEN target_symbol_id IS NOT NULL THEN target_symbol_id WHEN length(trim(target_name, {_BLANKS})) > 0 THEN trim(target_name, {_BLANKS}) END AS key_value FROM refs)"""

ORACLE = {
    "p3_found": f"WITH RECURSIVE {_NODES} SELECT symbol_id FROM nodes WHERE sid NOT IN (SELECT sid FROM tree)",
    "p3_hierarchy": f"""WITH RECURSIVE {_NODES} SELECT n.symbol_id, t.root AS root_id, t.depth, t.path, t.sid IS NOT NULL AS has_root
FROM nodes n LEFT JOIN tree t ON n.sid = t.sid""",
    "p3_descendants": f"""WITH RECURSIVE {_NODES}, up AS (SELECT sid, pid, CAST(1 AS BIGINT) AS distance FROM nodes WHERE pid IS NOT NULL AND sid IN (SELECT sid FROM tree)
  UNION ALL SELECT u.sid, n.pid, u.distance + 1 FROM up u JOIN nodes n ON u.pid = n.sid WHERE n.pid IS NOT NULL)
SELECT pid AS ancestor_id, sid AS symbol_id, distance FROM up""",
    "p5_found": f"""WITH {_KEYED} SELECT key_field, key_value FROM keyed WHERE key_field IS NOT NULL GROUP BY key_field, key_value
HAVING count(DISTINCT reference_id) >= 0.01 * (SELECT count(DISTINCT reference_id) FROM refs)""",
    "p5_keys": f"""WITH {_KEYED}, t AS (SELECT count(DISTINCT reference_id) AS total FROM refs)
SELECT key_field, key_value, count(DISTINCT reference_id) AS n_references, count(DISTINCT file_id) AS n_files, count(DISTINCT source_symbol_id) AS n_symbols,
  count(DISTINCT reference_id) >= 0.01 * (SELECT total FROM t) AS is_heavy FROM keyed WHERE key_field IS NOT NULL GROUP BY key_field, key_value""",
}
