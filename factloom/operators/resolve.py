"""Project-wide name resolution as joins of tiers.

References carry names; definitions carry qualified names. A tier only sees what the tiers before it left open, and a name is resolved
only where exactly one definition matches: several make it ambiguous, never an arbitrary pick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import suffixes
from factloom.operators.skew import balanced_left_join
from factloom.session import Scratch


def resolve_dependencies(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, kind, target, line, is_candidate, target_file_id, status, confidence) of deps (file_id, kind, target, line, is_candidate).

    Imports: the dotted module by exact path, else by the only path that ends in it (inferred), else ambiguous; with a known top name
    unresolved, else external. Includes: the path as written, else the only file that ends in it, else external. Candidates count only when resolved.
    files: (file_id, path).
    """
    stem = F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/__init__$", "")
    named = files.select("file_id", F.regexp_replace(stem, "/", ".").alias("module"), F.col("path"))
    exact = named.select(F.col("module").alias("target"), "file_id", F.lit("import").alias("kind"), F.lit(0).alias("tier"))
    tails = named.select(F.explode(suffixes(F.col("module"))).alias("target"), "file_id").select("target", "file_id", F.lit("import").alias("kind"), F.lit(1).alias("tier"))
    parts = F.split("path", "/")
    paths = named.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("t"), F.when(i == 1, 0).otherwise(1).alias("tier")))).alias("x"), "file_id")
    paths = paths.select(F.col("x.t").alias("target"), "file_id", F.lit("include").alias("kind"), F.col("x.tier").alias("tier"))
    found = _best(exact.unionByName(tails).unionByName(paths), ["kind", "target"], "file_id")
    tops = named.select(F.split("module", r"\.")[0].alias("top")).distinct().withColumn("known", F.lit(True))
    d = deps.join(found, ["kind", "target"], "left").withColumn("top", F.split("target", r"\.")[0]).join(tops, "top", "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when((F.col("kind") == "import") & F.col("known"), "unresolved").otherwise("external")
    d = d.withColumn("status", status).where(~F.coalesce("is_candidate", F.lit(False)) | (F.col("status") == "resolved"))
    return d.select("file_id", "kind", "target", "line", "is_candidate", F.when(F.col("n") == 1, F.col("hit")).alias("target_file_id"), "status", F.when((F.col("status") == "resolved") & (F.col("tier") == 0), "confirmed").otherwise("inferred").alias("confidence"))


def _best(hits: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, tier, n, hit): the best tier of each key, how many different hits it has, and the hit if one."""
    per = hits.groupBy(*key, "tier").agg(F.count_distinct(value).alias("n"), F.min(value).alias("hit"))
    return per.groupBy(*key).agg(F.min(F.struct("tier", "n", "hit")).alias("b")).select(*key, "b.*")


def resolve_references(refs: DataFrame, symbols: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """refs (file_id, source, kind, target, line, note) with (target_id, status, confidence, reason) added.

    symbols: (sid, qname, name, kind, decorators). Tiers: exact qualified name; the only qualified name that ends in the target (inferred); unresolved where
    the top name belongs to a definition, else external. A decorated target is only inferred, except in inheritance. Builtins are external.
    Declarations yield to definitions. Hot names go by broadcast and null hits are spread. operators.tiers resolves by the kind of key instead.
    """
    decl = F.coalesce(F.col("kind").endswith("declaration"), F.lit(False))
    s = symbols.where(F.col("kind") != "local_variable").select("sid", "qname", decl.cast("int").alias("decl"), (F.coalesce(F.size("decorators"), F.lit(0)) > 0).alias("decorated"))
    exact = s.select(F.col("qname").alias("target"), F.col("decl").alias("tier"), "sid")
    tails = s.select(F.explode(suffixes(F.col("qname"))).alias("target"), (F.col("decl") + 2).alias("tier"), "sid")
    found = _best(exact.unionByName(tails), ["target"], "sid")
    scratch = Scratch(refs.sparkSession, "resolve")
    found = scratch.save(found.join(s.groupBy(F.col("sid").alias("hit")).agg(F.max("decorated").alias("decorated")), "hit", "left"))
    refs = scratch.save(refs)
    r = balanced_left_join(refs, found, "target", "line", scratch)
    parts = F.split("target", r"::|\.")
    tops = symbols.select(F.split("qname", r"::|\.")[0].alias("top")).union(symbols.select(F.col("name"))).where(F.col("top").isNotNull()).distinct().withColumn("known", F.lit(True))
    r = balanced_left_join(scratch.save(r.withColumn("top", parts[0])), tops, "top", "line", scratch)
    status = (
        F.when(F.length("target") == 0, "unresolved").when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("note") == "builtin", "external").when(F.col("known"), "unresolved").otherwise("external")
    )
    sure = (F.col("status") == "resolved") & (F.col("tier") <= 1) & (~F.coalesce("decorated", F.lit(False)) | (F.col("kind") == "inheritance"))
    reason = F.when(F.col("status") == "ambiguous", "several candidates").when((F.col("status") == "unresolved") & F.col("known"), "no such member").when(F.length("target") == 0, "no name").otherwise("")
    return r.withColumn("status", status).select("file_id", "source", "kind", "target", "line", "note", F.when(F.col("n") == 1, F.col("hit")).alias("target_id"), "status", F.when(sure, "confirmed").otherwise("inferred").alias("confidence"), reason.alias("reason"))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` whose columns differ from ``old`` under the same key, or that are new; null equals null."""
    o = old.select(key, F.struct(*columns).alias("_old"))
    return new.join(o, key, "left").where(~F.col("_old").eqNullSafe(F.struct(*columns))).drop("_old")
