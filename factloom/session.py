"""Sessions, and intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", app: str = "factloom") -> SparkSession:
    """A single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in a
    single-process test, a temporary folder of this machine is set instead.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"factloom-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into as many partitions as the session shuffles into, at least one per core.

    For the sides of a join before a costly Python stage: the join keeps this partitioning, and adaptive execution does not merge
    partitions that are small in bytes but not in work.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    A written table cuts the lineage of an iterative plan, keeps its columns prunable and does
    not depend on any executor's disk. ``drop`` removes a superseded round at once; what is
    left goes when the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self.clear)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def save_counted(self, df: DataFrame, which: str | None = None) -> tuple[DataFrame, int]:
        """The written table and the number of its rows, which Parquet's footers tell; with ``which``, a boolean column, whether it holds anywhere (0 or 1)."""
        out = self.save(df)
        return out, out.count() if which is None else int(not out.where(which).isEmpty())

    def drop(self, df: DataFrame | None) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        self._paths.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            if jvm is None:
                return
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit
            pass
