"""Writing facts and drawing graphs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def cascade(project_id: str, tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """The tables without a project and what hangs from its files."""
    gone = files.where(F.col("project_id") == project_id).select("file_id").distinct()
    out = {}
    for name, df in tables.items():
        out[name] = df.where(~F.coalesce(F.col("project_id") == project_id, F.lit(False))) if "project_id" in df.columns else df.join(gone, "file_id", "left_anti")
    return out


def replace_imported(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without earlier imports of what ``new`` brings, with ``new``: the same input (source_sha256), or the same tool and source_name."""
    same_input = new.select("source_sha256").where(F.col("source_sha256").isNotNull()).distinct()
    same_source = new.select("tool", "source_name").distinct()
    return old.join(same_input, "source_sha256", "left_anti").join(same_source, ["tool", "source_name"], "left_anti").unionByName(new)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``. Any other failure to look is raised, as taking it for an empty table would lose rows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def write_facts(df: DataFrame, path: str, buckets: int = 64, key: str = "file_id", analysed: DataFrame | None = None) -> None:
    """Replace the facts of the files in ``df``: a dynamic overwrite of the buckets that their hashes fall into, one directory each.

    Rows of other files in those buckets are kept, so a run rewrites only what it touches. ``analysed`` (key): all files of the run, so
    that those without facts lose their old ones; unless given, the files in ``df``. A table that exists but cannot be read fails the call and stays as it is.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    with_bucket, ids = df.withColumn("bucket", bucket), (df if analysed is None else analysed.select(key).union(df.select(key))).select(key).distinct()
    if table_exists(spark, path):
        from factloom.session import Scratch

        old = spark.read.parquet(path)
        scratch = Scratch(spark, "facts")
        ids = scratch.save(ids)
        touched = ids.select(bucket.alias("bucket")).distinct()  # at most ``buckets`` rows
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(ids, key, "left_anti")
        with_bucket = scratch.save(with_bucket.unionByName(kept.select(*with_bucket.columns)))
        # a bucket that has lost its last row isn't overwritten by a dynamic overwrite
        emptied = [r[0] for r in touched.join(with_bucket.select("bucket").distinct(), "bucket", "left_anti").collect()]
    else:
        emptied = []
    with_bucket.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in emptied:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _escape(text: str, quotes: str) -> str:
    text = "".join(c if c.isprintable() else " " for c in text)[:80]
    return text.replace("\\", "\\\\").replace('"', quotes).replace("<", "&lt;").replace(">", "&gt;")


def _collected(edges: DataFrame, limit: int) -> list:
    """A graph to draw is small by nature; one that is not is refused rather than cut."""
    rows = edges.select("src", "dst", "style").orderBy("src", "dst", "style").take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} edges; restrict the graph first")
    return rows


def mermaid(edges: DataFrame, limit: int = 2_000) -> str:
    """A flow chart of (src, dst, style); edges that are not confirmed are dashed."""
    rows = _collected(edges, limit)
    ids = {n: f"n{i}" for i, n in enumerate(sorted({r.src for r in rows} | {r.dst for r in rows}))}
    out = ["flowchart LR", *[f'  {k}["{_escape(n, "&quot;")}"]' for n, k in ids.items()]]
    return "\n".join(out + [f"  {ids[r.src]} {'-->' if r.style == 'confirmed' else '-.->'} {ids[r.dst]}" for r in rows]) + "\n"


def dot(edges: DataFrame, limit: int = 2_000) -> str:
    rows = _collected(edges, limit)
    lines = [f'  "{_escape(r.src, chr(92) + chr(34))}" -> "{_escape(r.dst, chr(92) + chr(34))}"{"" if r.style == "confirmed" else " [style=dashed]"};' for r in rows]
    return "digraph {\n" + "\n".join(lines) + "\n}\n"


def graph_json(edges: DataFrame, limit: int = 2_000) -> str:
    rows = _collected(edges, limit)
    return json.dumps({"schema": "graph/1", "nodes": sorted({r.src for r in rows} | {r.dst for r in rows}), "edges": [r.asDict() for r in rows]}, sort_keys=True)


def _fence(lines: list[str]) -> str:
    """A fence longer than any run of backticks in the lines."""
    longest = run = 0
    for c in "\n".join(lines):
        run = run + 1 if c == "`" else 0
        longest = max(longest, run)
    return "`" * max(3, longest + 1)


def extract_markdown(items: DataFrame, lines: DataFrame, limit: int = 200) -> str:
    """Extracted functions as Markdown: items (rank, sid, qname, path, start_line, end_line, distance, parent) by rank, each with its lines (sid, line, text).

    An extract is small by nature; one of more than ``limit`` items is refused rather than cut.
    """
    rows = items.orderBy("rank").take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} items; restrict the extract first")
    code: dict[str, list] = {}
    for r in lines.join(items.select("sid"), "sid", "left_semi").orderBy("sid", "line").toLocalIterator():
        code.setdefault(r.sid, []).append(f"{r.line} | {r.text}")
    out = ["| # | function | place | depth | from |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {k} | `{r.qname}` | `{r.path}:{r.start_line}-{r.end_line}` | {r.distance} | {r.parent or ''} |" for k, r in enumerate(rows, 1)]
    for k, r in enumerate(rows, 1):
        body = code.get(r.sid, [])
        fence = _fence(body)
        out += ["", f"## {k}. {r.qname}", "", f"`{r.path}:{r.start_line}-{r.end_line}`", *(["", fence, *body, fence] if body else [])]
    return "\n".join(out) + "\n"


def tree_text(paths: DataFrame, limit: int = 5_000) -> str:
    """Directories, files and symbols as an indented tree: paths (path, symbol, start_line), symbol null for the file alone. Larger trees are refused."""
    rows = paths.select("path", "symbol", "start_line").distinct().orderBy("path", F.asc_nulls_first("start_line"), F.asc_nulls_first("symbol")).take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; restrict the tree first")
    out, shown = [], set()
    for r in rows:
        parts = r.path.split("/")
        for k in range(len(parts)):
            at = "/".join(parts[: k + 1])
            if at not in shown:
                shown.add(at)
                out.append("  " * k + parts[k] + ("/" if k < len(parts) - 1 else ""))
        if r.symbol is not None:
            out.append("  " * len(parts) + r.symbol)
    return "\n".join(out) + "\n"
