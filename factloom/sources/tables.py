"""Reading the fact tables of one directory, and their cleaned forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.functions.text import clean_id, trim_blanks

#: File name extension to language.
EXTENSION_LANGUAGE = {
    "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
    "py": "python", "pyi": "python",
    "el": "elisp", "org": "elisp",
    "go": "go",
}


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of Parquet tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def normal_path(path: Column) -> Column:
    """A path in one notation: slashes, no leading ``./``, no doubled slashes, no blanks around."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(trim_blanks(path), r"\\", "/"), "/{2,}", "/"), r"^(\./)+", "")


def extension_language(path: Column) -> Column:
    """The language that a path's file name extension states; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [x for k, v in EXTENSION_LANGUAGE.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), ext)


def latest_files(files: DataFrame) -> DataFrame:
    """One row per file_id: the scan with the latest last_analyzed_at.

    A null time is the oldest. Exact ties are broken by the remaining columns, so that the choice
    does not depend on row order. Aggregation by maximum is combined before the shuffle, so a
    file_id with very many scans is no hot task. Rows without file_id are left out. Adds path
    (one notation) and stated (language by extension).
    """
    rest = [c for c in ("project_id", "relative_path", "language", "content_hash", "analysis_status", "analyzer_version") if c in files.columns]
    newest = F.max(F.struct(F.col("last_analyzed_at").isNotNull().alias("has"), F.col("last_analyzed_at").alias("at"), *[F.col(c).alias(c) for c in rest])).alias("m")
    out = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(newest)
    out = out.select("file_id", F.col("m.at").alias("last_analyzed_at"), *[F.col(f"m.{c}").alias(c) for c in rest])
    out = out.withColumn("path", normal_path(F.col("relative_path")))
    return out.withColumn("stated", extension_language(F.col("path")))


_SYMBOL_COLUMNS = ("file_id", "name", "qualified_name", "kind", "start_line", "end_line", "decorators", "base_classes", "is_async", "is_generator", "usr", "summary")


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """One row per symbol id (ids compare trimmed and in lower case), with the id as ``sid``
    and the parent's as ``pid`` (null if empty). Of conflicting rows the least non-null values count; columns that the table does not define are dropped."""
    keep = [c for c in _SYMBOL_COLUMNS if c in symbols.columns]
    base = symbols.withColumn("sid", clean_id(F.col("symbol_id"))).withColumn("pid", clean_id(F.col("parent_symbol_id"))).where(F.col("sid").isNotNull())
    return base.groupBy("sid").agg(F.min("symbol_id").alias("symbol_id"), F.min("pid").alias("pid"), *[F.min(c).alias(c) for c in keep])
