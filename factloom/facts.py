"""The cleaned fact tables of one directory, built lazily."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.text import clean_id, trim_blanks
from factloom.sources import tables

#: The kinds of references by which one symbol uses another.
USES = ("call", "name_ref", "function_ref", "inheritance", "type_use")


class Facts:
    """files, symbols, refs and deps in one spelling, without repeats.

    Columns: files as of tables.latest_files; symbols (sid, pid, file_id, name, qname, kind, start_line, end_line, decorators,
    base_classes, usr, summary, is_async); refs (reference_id, file_id, src, dst, tname, kind, start_line, status, confidence,
    note); deps (dependency_id, file_id, target_file_id, tname, kind, start_line, status, confidence), candidates only if resolved.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return tables.load(self.spark, self.directory, name)

    @cached_property
    def files(self) -> DataFrame:
        return tables.latest_files(self.raw("source_files"))

    @cached_property
    def symbols(self) -> DataFrame:
        s = tables.distinct_symbols(self.raw("symbols"))
        qname = F.coalesce(F.when(F.length(trim_blanks(F.col("qualified_name"))) > 0, F.col("qualified_name")), F.col("name"))
        return s.select("sid", "symbol_id", "pid", "file_id", "name", qname.alias("qname"), F.lower(trim_blanks(F.col("kind"))).alias("kind"), "start_line", "end_line", "decorators", "base_classes", "usr", "summary", "is_async")

    @cached_property
    def refs(self) -> DataFrame:
        """Exact repeats collapse on the selected columns, so pruned queries shuffle only what they use."""
        return self.refs_of("file_id", "src", "dst", "tname", "kind", "start_line", "status", "confidence", "note")

    def refs_of(self, *columns: str) -> DataFrame:
        made = {
            "src": clean_id(F.col("source_symbol_id")),
            "dst": clean_id(F.col("target_symbol_id")),
            "tname": trim_blanks(F.col("target_name")),
            "kind": F.lower(trim_blanks(F.col("reference_kind"))),
            "status": F.lower(trim_blanks(F.col("resolution_status"))),
            "confidence": F.lower(trim_blanks(F.col("confidence"))),
        }
        return self.raw("refs").select("reference_id", *[made[c].alias(c) if c in made else F.col(c) for c in columns]).distinct()

    @cached_property
    def deps(self) -> DataFrame:
        d = self.raw("deps").select(
            "dependency_id",
            F.col("source_file_id").alias("file_id"),
            "target_file_id",
            trim_blanks(F.col("target_name")).alias("tname"),
            F.lower(trim_blanks(F.col("dependency_kind"))).alias("kind"),
            "start_line",
            F.lower(trim_blanks(F.col("resolution_status"))).alias("status"),
            F.lower(trim_blanks(F.col("confidence"))).alias("confidence"),
            F.coalesce(F.col("is_candidate"), F.lit(False)).alias("is_candidate"),
        )
        return d.distinct().where(~F.col("is_candidate") | (F.col("status") == "resolved")).drop("is_candidate")

    def calls(self, *columns: str) -> DataFrame:
        """Resolved calls (reference_id, src, dst, ...) between different symbols."""
        c = self.refs_of(*dict.fromkeys(["src", "dst", "kind", "status", *columns]))
        return c.where((F.col("kind") == "call") & (F.col("status") == "resolved") & (F.col("src") != F.col("dst"))).drop("kind", "status")

    def uses(self) -> DataFrame:
        """Distinct (src, dst) of resolved uses between different symbols."""
        r = self.refs_of("src", "dst", "kind", "status").where(F.col("kind").isin(*USES) & (F.col("status") == "resolved") & (F.col("src") != F.col("dst")))
        return r.select("src", "dst").distinct()

    def file_edges(self) -> DataFrame:
        """Distinct (src, dst) of resolved dependencies between different files."""
        d = self.deps.where((F.col("status") == "resolved") & (F.col("file_id") != F.col("target_file_id")))
        return d.select(F.col("file_id").alias("src"), F.col("target_file_id").alias("dst")).distinct()

    def save(self, target: str) -> CleanFacts:
        """Write the cleaned tables once; queries on what is returned read them as they are, so that their filters reach the Parquet scan.

        Rows lie sorted by what filters ask for most, so that whole row groups are skipped.
        """
        for name, order in (("files", ["stated", "path"]), ("symbols", ["kind", "name"]), ("refs", ["kind", "status", "dst"]), ("deps", ["status", "kind"])):
            getattr(self, name).repartitionByRange(*order, "file_id").sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")
        return CleanFacts(self.spark, self.directory, target)


class CleanFacts(Facts):
    """Facts whose cleaned tables Facts.save() wrote to ``clean``; all other tables come from ``directory``."""

    def __init__(self, spark: SparkSession, directory: str, clean: str):
        super().__init__(spark, directory)
        self.clean = clean.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.clean}/{name}")

    @cached_property
    def files(self) -> DataFrame:
        return self._read("files")

    @cached_property
    def symbols(self) -> DataFrame:
        return self._read("symbols")

    @cached_property
    def deps(self) -> DataFrame:
        return self._read("deps")

    def refs_of(self, *columns: str) -> DataFrame:
        return self._read("refs").select("reference_id", *columns).distinct()
