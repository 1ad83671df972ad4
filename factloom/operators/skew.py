"""Joins against a table of unique keys that stay balanced under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.session import Scratch

#: Rows that one task takes without harm, whatever their share.
LEAST_HOT = 10_000


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, whose ``key`` is unique, with the keys in ``hot`` sent by broadcast.

    ``hot`` comes from find_hot(), whose number of rows has a bound that does not depend on the
    data, so the broadcast side holds at most that many rows of ``right``. All other rows take the
    shuffle, in which no key is hot. No row is dropped or repeated.
    """
    if hot is None:
        return left.join(right, key, how)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = right.join(F.broadcast(hot), key, "left_semi")
    heavy = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(few), key, how)
    light = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, key, how)
    return light.unionByName(heavy)


def find_hot(df: DataFrame, key: str, n_rows: int, scratch: Scratch) -> DataFrame | None:
    """The hot keys of ``df`` as a written table, or None if there are none."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n_rows <= LEAST_HOT:
        return None
    hot = scratch.save(hot_keys(df, key, n_rows, parts))
    return None if hot.isEmpty() else hot


def hot_keys(df: DataFrame, key: str, n_rows: int, parts: int) -> DataFrame:
    """Keys with more than 1/(4 parts) of ``n_rows``: fewer than 4 * parts of them can exist."""
    least = max(LEAST_HOT, n_rows // (4 * max(1, parts)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(key)


#: Parts into which each group is split before its first rows are ranked.
SALTS = 256


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, salt: str, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their rank.

    Ranked within SALTS parts of a group first, so that a group that holds a third of all rows is no single sort: its last window sees
    at most n rows of each part. ``salt`` names a column that spreads the rows; ties must be broken by ``order``.
    """
    part = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    first = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_salt")
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def away_from_null(key: str, salt: str) -> Column:
    """The key, or where it is null one of SALTS values that no key equals: rows without key then spread over all tasks of a join instead of meeting in one."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("string")))


def balanced_left_join(left: DataFrame, right: DataFrame, key: str, salt: str, scratch: Scratch) -> DataFrame:
    """``left`` left-joined to ``right``, whose ``key`` is unique; null keys are spread by ``salt`` and hot ones found by a count and sent by broadcast."""
    n = left.where(F.col(key).isNotNull()).count()
    hot = find_hot(left, key, n, scratch)
    named = left.withColumn("_key", away_from_null(key, salt))
    out = lookup_join(named, right.withColumnRenamed(key, "_key"), "_key", None if hot is None else hot.withColumnRenamed(key, "_key"))
    return out.drop("_key")
