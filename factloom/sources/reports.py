"""Readers for the reports of other tools: SARIF, radare2, SCIP, observations, gcov and git logs. Input is untrusted: sizes are
bounded, paths outside the root are dropped, and what does not parse gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MESSAGE_CHARS = 500
_REGION = "region:struct<startLine:int,endLine:int>"
_SARIF = f"runs array<struct<tool:struct<driver:struct<name:string,version:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,{_REGION}>>>>>>>"


def relative_uri(uri: Column) -> Column:
    """A project-relative path of a URI; null if it is absolute, has another scheme or climbs out of the root."""
    path = F.regexp_replace(F.regexp_replace(F.try_url_decode(uri), "^(file://)?(\\./)*", ""), "/{2,}", "/")
    return F.when(~path.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|/|[A-Za-z]:\\)|(^|/)\.\.(/|$)") & (F.length(path) > 0), path)


def sarif(reports: DataFrame) -> DataFrame:
    """(tool, version, rule, level, message, path, start_line, end_line) of reports (json): the first location of each result.

    The level is warning unless stated; messages have single blanks and at most 500 characters; results without a location inside the root are dropped.
    """
    run = reports.select(F.explode(F.from_json("json", _SARIF)["runs"]).alias("r"))
    res = run.select(F.col("r.tool.driver.name").alias("tool"), F.col("r.tool.driver.version").alias("version"), F.explode("r.results").alias("x"))
    at = F.col("x.locations")[0]["physicalLocation"]
    out = res.select(
        "tool",
        "version",
        F.col("x.ruleId").alias("rule"),
        F.coalesce(F.lower("x.level"), F.lit("warning")).alias("level"),
        F.substring(F.trim(F.regexp_replace(F.coalesce("x.message.text", F.lit("")), r"\s+", " ")), 1, MESSAGE_CHARS).alias("message"),
        relative_uri(at["artifactLocation"]["uri"]).alias("path"),
        at["region"]["startLine"].alias("start_line"),
        F.coalesce(at["region"]["endLine"], at["region"]["startLine"]).alias("end_line"),
    )
    return out.where(F.col("path").isNotNull())


LEVELS = ("none", "note", "warning", "error")


def at_least(findings: DataFrame, level: str) -> DataFrame:
    """Findings of at least a level."""
    return findings.where(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")) > LEVELS.index(level))


def r2_functions(reports: DataFrame) -> DataFrame:
    """(name, addr, size, file, signature, nbbs, indegree, outdegree) of function lists (json)."""
    schema = "array<struct<name:string,addr:bigint,size:bigint,file:string,signature:string,nbbs:int,indegree:int,outdegree:int>>"
    return reports.select(F.explode(F.from_json("json", schema)).alias("f")).select("f.*").where(F.col("name").isNotNull())


def r2_calls(reports: DataFrame) -> DataFrame:
    """(caller, callee) of call graphs (json), each edge once."""
    g = reports.select(F.explode(F.from_json("json", "array<struct<name:string,size:bigint,imports:array<string>>>")).alias("g"))
    return g.select(F.col("g.name").alias("caller"), F.explode("g.imports").alias("callee")).where(F.col("caller").isNotNull() & F.col("callee").isNotNull()).distinct()


def binary_names(name: Column) -> Column:
    """Names under which a binary's function may be in the source: without prefix and argument list, and without one leading underscore."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^(sym\.imp\.|sym\.|fcn\.|dbg\.|loc\.)", ""), r"\(.*$", "")
    return F.array_distinct(F.filter(F.array(bare, F.regexp_replace(bare, "^_", "")), lambda x: F.length(x) > 0))


_OBSERVED = (
    "functions array<struct<file:string,qualname:string,line:int,count:bigint>>, calls array<struct<caller:string,callee:string,count:bigint>>, lines map<string,array<int>>, "
    "raised array<struct<type:string,file:string,line:int,function:string,count:bigint>>, io array<struct<kind:string,detail:string,caller:string,count:bigint>>"
)


def observations(runs: DataFrame) -> DataFrame:
    """(run_id, kind, subject, object, line, count) of runs (run_id, json): calls, executed functions, covered lines, failures and input/output."""
    r = runs.select("run_id", F.from_json("json", _OBSERVED).alias("o"))
    null, one = F.lit(None).cast("string"), F.lit(1).cast("long")

    def part(column: str, kind: str, subject: str, object_, line, count) -> DataFrame:
        x = r.select("run_id", F.explode(F.col(f"o.{column}")).alias("x"))
        return x.select("run_id", F.lit(kind).alias("kind"), F.col(subject).alias("subject"), object_.alias("object"), line.cast("int").alias("line"), count.cast("long").alias("count"))

    none = F.lit(None)
    out = part("calls", "call", "x.caller", F.col("x.callee"), none, F.col("x.count"))
    out = out.unionByName(part("functions", "function", "x.qualname", F.col("x.file"), F.col("x.line"), F.col("x.count")))
    out = out.unionByName(part("raised", "failure", "x.function", F.col("x.type"), F.col("x.line"), F.col("x.count")))
    out = out.unionByName(part("io", "io", "x.caller", F.concat_ws(" ", "x.kind", "x.detail"), none, F.col("x.count")))
    lines = r.select("run_id", F.explode("o.lines").alias("path", "covered")).select("run_id", F.lit("coverage").alias("kind"), F.col("path").alias("subject"), null.alias("object"), F.explode("covered").alias("line"), one.alias("count"))
    return out.unionByName(lines)


def match_observed(observed: DataFrame, symbols: DataFrame) -> DataFrame:
    """observed functions (path, qualname, line) with the one symbol (sid, path, qname, start_line) they are.

    Equal path, and a qualified name equal or ending in the observed one without its <locals> parts; of several, those within one line; else none.
    """
    from factloom.functions.text import suffixes

    want = observed.withColumn("q", F.regexp_replace("qualname", r"\.<locals>", ""))
    keys = symbols.select("sid", "path", "start_line", F.explode(F.array_union(F.array("qname"), suffixes(F.col("qname")))).alias("q"))
    hits = want.join(keys, ["path", "q"])
    near = F.abs(F.col("start_line") - F.col("line")) <= 1
    per = hits.groupBy("path", "qualname", "line").agg(F.count_distinct("sid").alias("n"), F.min("sid").alias("one"), F.count_distinct(F.when(near, F.col("sid"))).alias("m"), F.min(F.when(near, F.col("sid"))).alias("close"))
    sid = F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("close"))
    return observed.join(per, ["path", "qualname", "line"], "left").select(*observed.columns, sid.alias("sid"))


def gcov(lines: DataFrame) -> DataFrame:
    """(path, line, count) of gcov text (value, one line a row, source names before their lines in ``source``): executed and missed lines."""
    m = lines.select(F.regexp_extract("value", r"^\s*([0-9]+|#####|=====|-)\*?:\s*(\d+):", 1).alias("c"), F.regexp_extract("value", r"^\s*[^:]+:\s*(\d+):", 1).alias("line"), F.col("source").alias("path"))
    m = m.where((F.col("c") != "") & (F.col("c") != "-") & (F.col("line") != "0"))
    return m.select("path", F.col("line").cast("int").alias("line"), F.when(F.col("c").rlike("^[0-9]+$"), F.col("c").cast("long")).otherwise(0).alias("count"))


def git_log(logs: DataFrame) -> DataFrame:
    """(commit, author, day, path) of the output of ``git log --name-only --date=short --format=%x01%H%x02%an%x02%ad`` (text)."""
    block = logs.select(F.explode(F.split("text", "\u0001")).alias("b")).where(F.length("b") > 0)
    rows = F.split("b", "\n")
    head = F.split(rows[0], "\u0002")
    out = block.select(head[0].alias("commit"), F.try_element_at(head, F.lit(2)).alias("author"), F.try_element_at(head, F.lit(3)).alias("day"), F.explode(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).alias("path"))
    return out.where(F.length("path") > 0)


def git_lines(logs: DataFrame) -> DataFrame:
    """(path, start, end, rank, commit, author, day, subject) of the commits that touched a range of lines, newest first at rank 0.

    logs: (path, start, end, text) with the output of ``git log -s -L start,end:path --date=short --format=%x01%H%x02%an%x02%ad%x02%s``.
    """
    block = logs.select("path", "start", "end", F.posexplode(F.filter(F.split("text", "\u0001"), lambda b: F.length(F.trim(b)) > 0)).alias("rank", "b"))
    part = F.split(F.regexp_replace("b", r"\s+$", ""), "\u0002")
    named = [F.try_element_at(part, F.lit(k)).alias(n) for k, n in enumerate(("commit", "author", "day", "subject"), 1)]
    return block.select("path", "start", "end", "rank", *named)


def observed_of(observed: DataFrame, run_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Observations of one run, of one kind, or both, in a fixed order."""
    out = observed if run_id is None else observed.where(F.col("run_id") == run_id)
    out = out if kind is None else out.where(F.col("kind") == kind)
    return out.orderBy("run_id", "kind", "subject", F.asc_nulls_first("object"), F.asc_nulls_first("line"))


# -- SCIP: the wire format of protocol buffers ------------------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message; values are ints for varints and bytes for what has a length."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            if at + n > len(data):
                raise ValueError("cut off")
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("bad wire type")
        yield key >> 3, value


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append(v)
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "start_line", "start_col", "end_line", "symbol", "roles"]
    for batch in batches:
        rows = []
        for data in batch.column(0).to_pylist():
            try:
                got = []
                for n, doc in fields(data or b""):
                    if n != 2 or not isinstance(doc, bytes):
                        continue
                    path, occ = "", []
                    for k, v in fields(doc):
                        if k == 1:
                            path = v.decode("utf-8", "replace")
                        elif k == 2:
                            o = {a: b for a, b in fields(v)}
                            r = _packed(o[1]) if isinstance(o.get(1), bytes) else []
                            if len(r) in (3, 4):
                                occ.append((r[0], r[1], r[2] if len(r) == 4 else r[0], o.get(2, b"").decode("utf-8", "replace"), int(o.get(3, 0))))
                    got += [(path, *x) for x in occ]
                rows += got
            except (ValueError, AttributeError):
                continue
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def scip(indexes: DataFrame) -> DataFrame:
    """(path, start_line, start_col, end_line, symbol, is_definition, name) of SCIP indexes (content binary); lines count from 0 as in the format."""
    o = indexes.select("content").mapInArrow(_occurrences, "path string, start_line int, start_col int, end_line int, symbol string, roles int")
    last = F.regexp_extract(F.regexp_replace("symbol", r"\(\+?\w*\)\.$|[.#/:!]$|`", ""), r"([^\s./#:]+)$", 1)
    return o.select("path", "start_line", "start_col", "end_line", "symbol", (F.col("roles").bitwiseAND(F.lit(1)) == 1).alias("is_definition"), last.alias("name"))
