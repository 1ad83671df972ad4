"""Keeping facts up to date: which files to analyse again, and a stream of scans as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.graph import bfs


def plan(old: DataFrame, new: DataFrame, includes: DataFrame, analyzer_version: str) -> DataFrame:
    """(file_id, action): analyze, keep or remove.

    old: (file_id, content_hash, analyzer_version); new: (file_id, content_hash, is_header). A file is kept if hash and version match and no
    header that it includes, directly or not, has changed. includes: (src, dst) of files.
    """
    both = new.join(old.select("file_id", F.col("content_hash").alias("was"), F.col("analyzer_version").alias("by")), "file_id", "full_outer")
    same = F.coalesce((F.col("content_hash") == F.col("was")) & (F.col("by") == analyzer_version), F.lit(False))
    state = both.select("file_id", "is_header", F.when(F.col("content_hash").isNull(), "remove").when(same, "keep").otherwise("analyze").alias("action"))
    seeds = state.where((F.col("action") != "keep") & F.coalesce("is_header", F.lit(True))).select(F.col("file_id").alias("node"))
    forced = bfs(includes, seeds, reverse=True).where(F.col("distance") > 0).select(F.col("node").alias("file_id"), F.lit(True).alias("forced"))
    return state.join(forced, "file_id", "left").select("file_id", F.when(F.col("forced") & (F.col("action") == "keep"), "analyze").otherwise(F.col("action")).alias("action"))


def latest_from_stream(spark: SparkSession, folder: str, schema, target: str, checkpoint: str):
    """A streaming query that folds new Parquet files of scans into a table of the latest scan per file.

    Each micro batch replaces only what is newer; a batch that is run again after a failure changes nothing, as the newest row wins.
    """
    from factloom.sinks import table_exists, write_facts
    from factloom.sources.tables import latest_files

    def fold(batch: DataFrame, _epoch: int) -> None:
        fresh = latest_files(batch).drop("path", "stated")
        if table_exists(batch.sparkSession, target):  # any failure to read it fails the batch, which runs again
            old = batch.sparkSession.read.parquet(target).drop("bucket")
            touched = old.join(fresh.select("file_id"), "file_id", "left_semi")
            fresh = latest_files(fresh.unionByName(touched)).drop("path", "stated")
        write_facts(fresh, target)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
