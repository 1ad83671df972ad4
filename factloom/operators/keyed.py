"""Per-key results where a few keys hold most rows.

Method: map-side combining. Every aggregate here is algebraic, so Spark's hash aggregation keeps
a bounded table per partition, spills it when full, and shuffles only mergeable partial states: one row per key and
partition. Repeated rows make counts of rows an upper bound only; distinct counts shuffle by (key, value), where no key
can be hot, with values as 128-bit hashes, and then by key with one partial state per partition. Heavy keys are
sought among those alone whose count of rows is large enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import trim_blanks
from factloom.session import Scratch

#: Share of the distinct references from which a key is heavy.
HEAVY_SHARE = 0.01


def keyed_refs(refs: DataFrame) -> DataFrame:
    """(reference_id, file_id, source_symbol_id, key_field, key_value).

    The key is target_symbol_id if that is not null, else target_name without surrounding blanks. Rows with
    neither, that is a null target and a null or blank name, keep null key columns.
    """
    name = trim_blanks(F.col("target_name"))
    by_id = F.col("target_symbol_id").isNotNull()
    by_name = F.coalesce(F.length(name) > 0, F.lit(False))
    return refs.select(
        "reference_id",
        "file_id",
        "source_symbol_id",
        F.when(by_id, "target_symbol_id").when(by_name, "target_name").alias("key_field"),
        F.when(by_id, F.col("target_symbol_id")).when(by_name, name).alias("key_value"),
    )


def fingerprint(c: str) -> list[Column]:
    """A value as two 64-bit hashes, half the size of an id of 32 digits and safe to count: among 10^12 values two agree with probability 10^-14."""
    return [F.xxhash64(c).alias("_h1"), F.xxhash64(F.lit(1), F.col(c)).alias("_h2")]


def _distinct(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(keys, name): the number of different non-null values of ``column`` for each key."""
    one = df.where(F.col(column).isNotNull()).select(*keys, *fingerprint(column)).distinct()
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _total(refs: DataFrame) -> Column:
    """The number of distinct reference_ids as a scalar subquery: one number, not a join side that grows with the data."""
    ids = refs.where(F.col("reference_id").isNotNull()).select(*fingerprint("reference_id")).distinct()
    return ids.agg(F.count(F.lit(1)).alias("n")).scalar()


def key_counts(refs: DataFrame) -> DataFrame:
    """(key_field, key_value, n_references): distinct reference_ids of each key.

    Rows with a null reference_id identify no reference and are not counted. Exact repeats
    count once. An empty table gives no rows.
    """
    return _distinct(keyed_refs(refs).where(F.col("key_field").isNotNull()), ["key_field", "key_value"], "reference_id", "n_references")


def heavy_keys(refs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys with at least ``share`` of the distinct reference_ids of the table, those without key included.

    Counts of rows come first, combined before the shuffle; only the keys that reach the share with repeats included are counted
    again without them. At most (rows / distinct ids) / share such keys exist; they are written, and their size decides how they are joined.
    """
    keys = ["key_field", "key_value"]
    rows = keyed_refs(refs).where(F.col("key_field").isNotNull() & F.col("reference_id").isNotNull())
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    scratch = Scratch(refs.sparkSession, "heavy")
    likely = scratch.save(counts.withColumn("least", _total(refs) * F.lit(share)).where(F.col("n") >= F.col("least")).drop("n"))
    exact = _distinct(rows.join(likely.select(*keys), keys, "left_semi"), keys, "reference_id", "n_references")
    return exact.join(likely, keys).where(F.col("n_references") >= F.col("least")).drop("least")


def key_profile(refs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(key_field, key_value, n_references, n_files, n_symbols, is_heavy) of every key.

    Null files and source symbols are not counted. Keys compare exactly as TESTDATA defines them. Each distinct count is an aggregate of its own, so that
    no row is multiplied; they meet on the keys.
    """
    keys = ["key_field", "key_value"]
    rows = keyed_refs(refs).where(F.col("key_field").isNotNull())
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    for column, name in (("reference_id", "n_references"), ("file_id", "n_files"), ("source_symbol_id", "n_symbols")):
        out = out.join(_distinct(rows, keys, column, name), keys, "left")
    counts = out.na.fill(0, ["n_references", "n_files", "n_symbols"])
    return counts.withColumn("is_heavy", F.col("n_references") >= _total(refs) * F.lit(share))
