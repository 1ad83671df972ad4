"""The files of a source tree, without what a project excludes, and what it declares to need."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.sources.tables import extension_language


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(regular expression, takes back) of the patterns of a .gitignore, for paths in which directories end in a slash."""
    out = []
    for line in lines:
        p = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
        if not p or p.startswith("#"):
            continue
        back = p.startswith("!")
        p = p[1:] if back else p[1:] if p.startswith(("\\#", "\\!")) else p
        directory = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        body, k = "", 0
        p = p.lstrip("/")
        while k < len(p):
            if p.startswith("**/", k):
                body, k = body + "(?:.*/)?", k + 3
            elif p.startswith("/**", k) and k + 3 == len(p):
                body, k = body + "/.*", k + 3
            elif p[k] == "*":
                body, k = body + "[^/]*", k + 1
            elif p[k] == "?":
                body, k = body + "[^/]", k + 1
            elif p[k] == "[" and (end := p.find("]", k + 2)) > 0:
                inner = p[k + 1 : end]
                body, k = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
            else:
                k += p[k] == "\\" and k + 1 < len(p)
                body, k = body + re.escape(p[k]), k + 1
        out.append(("^" + ("" if anchored else "(?:.*/)?") + body + ("/" if directory else "/?") + "$", back))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether rules ignore a file: the last rule that matches it decides, and nothing below an ignored directory is taken back."""

    def by_rules(x: Column) -> Column:
        out = F.lit(False)
        for pattern, back in rules:
            out = F.when(x.rlike(pattern), F.lit(not back)).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.exists(F.slice(above, 2, F.size(parts)), by_rules) | by_rules(path)


def scan(spark: SparkSession, root: str, exclude_dirs: list[str] = (), exclude_files: list[str] = (), gitignore: list[str] = ()) -> DataFrame:
    """(path, language, content_hash, content) of the files below ``root`` in the analysed languages.

    Excluded are files below directories of the names in ``exclude_dirs``, files of the names in ``exclude_files`` and what the rules of ``gitignore`` ignore. Only
    what is left is read. content is null where a file is not UTF-8. Object stores and Hadoop's file systems resolve links themselves.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = re.sub(r"^[a-z0-9]+:/*", "/", base) if re.match(r"^(file:|/)", base) else base
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(plain) + "/+", "")
    files = files.select(path.alias("path"), "content").withColumn("language", extension_language(F.col("path"))).where(F.col("language").isNotNull())
    parts = F.split("path", "/")
    if exclude_dirs:
        files = files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, exclude_dirs))))
    if exclude_files:
        files = files.where(~F.element_at(parts, -1).isin(*exclude_files))
    if rules := ignore_rules(list(gitignore)):
        files = files.where(~ignored(F.col("path"), rules))
    return files.select("path", "language", F.sha2("content", 256).alias("content_hash"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


_NEED = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)")


def needs(path: str, text: str) -> list[tuple[str, str]]:
    """(name, where) that a pyproject.toml or requirements file declares."""
    last = path.rsplit("/", 1)[-1]
    found: list[tuple[str, str]] = []
    if last == "pyproject.toml":
        try:
            meta = tomllib.loads(text).get("project", {})
        except tomllib.TOMLDecodeError:
            return []
        groups = {"dependencies": meta.get("dependencies") or [], **(meta.get("optional-dependencies") or {})}
        found = [(m.group(1), k) for k, names in groups.items() for n in names if (m := _NEED.match(str(n)))]
    elif re.fullmatch(r"requirements.*\.txt", last):
        found = [(m.group(1), last) for line in text.splitlines() if line.strip() and not line.lstrip().startswith(("#", "-")) and (m := _NEED.match(line))]
    return list(dict.fromkeys(found))


def declared(files: DataFrame) -> DataFrame:
    """(path, name, declared_in) of the requirements in files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *n) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n in needs(p or "", t or "")]
            yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 3)], names=["path", "name", "declared_in"])

    wanted = files.where(F.col("path").rlike(r"(^|/)(pyproject\.toml|requirements[^/]*\.txt)$"))
    return wanted.select("path", "content").mapInArrow(run, "path string, name string, declared_in string")


def cases(path: str, text: str, table: str = "case") -> list[dict]:
    """The tables of an array in a TOML file, such as questions with the definitions they expect; none of a text that isn't TOML."""
    try:
        found = tomllib.loads(text).get(table, [])
    except tomllib.TOMLDecodeError:
        return []
    return [dict(c, path=path) for c in found if isinstance(c, dict)]
