"""Facts extracted from the texts of source files, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.session import spread
from factloom.sources import brace_source, python_keys, python_source
from factloom.sources.tables import latest_files

_SCHEMAS = {
    "symbols": "file_id string, kind string, name string, qname string, start_line int, end_line int, parent string, decorators array<string>, bases array<string>, is_async boolean, is_generator boolean, summary string",
    "refs": "file_id string, source string, kind string, target string, line int, note string",
    "deps": "file_id string, kind string, target string, line int, is_candidate boolean",
    "flows": "file_id string, qname string, line int, branches int, loops int, try_blocks int, handlers int, swallowed int, reraises int, logs int, raises int, returns int, awaits int, yields int, with_blocks int, cyclomatic int, max_depth int, lines int",
    "variables": "file_id string, qname string, what string, name string, how string, line int, to string",
    "findings": "file_id string, qname string, rule string, level string, line int, detail string",
    "states": "file_id string, qname string, owner string, name string, access string, line int",
    "exceptions": "file_id string, qname string, what string, name string, line int, end_line int, caught boolean",
    "blocks": "file_id string, qname string, block int, start_line int, end_line int, to int, label string",
    "fields": "file_id string, qname string, name string, access string, line int",
    "exits": "file_id string, qname string, kind string, detail string, line int",
    "returns": "file_id string, qname string, value string, constant boolean, line int",
    "parameters": "file_id string, qname string, position int, name string, type string",
    "mutations": "file_id string, qname string, name string, how string, line int",
    "aliases": "file_id string, qname string, name string, target string, line int",
    "keys": "file_id string, source string, kind string, key string, a string, b string, line int, name string, position int",
    "exports": "file_id string, module string, name string, target string",
    "macros": "file_id string, name string, has_parameters boolean, body string, line int",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _columns(what: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _ARROW[t]) for n, t in (x.split(" ", 1) for x in _SCHEMAS[what].split(", "))]


def _run(batches: Iterator[pa.RecordBatch], what: str) -> Iterator[pa.RecordBatch]:
    columns = _columns(what)
    for batch in batches:
        rows = []
        for i, path, lang, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if what in ("keys", "exports"):
                found = python_keys.keys(text, path or "")[what == "exports"] if lang == "python" else []
            elif lang == "python":
                found = getattr(python_source.extract(text, path or "", what), what, [])
            else:
                found = brace_source.extract(text, path or "", lang, what).get(what, [])
            rows += [{"file_id": i, **r} for r in found]
        yield pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, t in columns], names=[n for n, _ in columns])


def facts_of(files: DataFrame, texts: DataFrame, what: str, languages: tuple[str, ...] = ("python", "c", "cpp", "go", "elisp")) -> DataFrame:
    """Rows of ``what`` (symbols, refs, deps, flows, variables or findings) of all files in ``languages`` by extension.

    Null contents give none, nor do Python texts that do not parse. Parsed file by file where the text lies; the only shuffle joins
    texts with their paths.
    """
    f = latest_files(files).where(F.col("stated").isin(*languages)).select("file_id", "path", F.col("stated").alias("lang"))
    t = texts.where(F.col("content").isNotNull()).select("file_id", "content")
    both = spread(f, "file_id").join(spread(t, "file_id"), "file_id")
    return both.select("file_id", "path", "lang", "content").mapInArrow(lambda b: _run(b, what), _SCHEMAS[what])
