"""Intermediate tables in the folder all executors share, and the size rule for broadcasts.

Iterative operators cut their lineage by writing a table and reading it back: a lost executor then
costs nothing but a re-read.  The folder is ``spark.checkpoint.dir`` of the session.  Where that is unset, a
session on one machine (``local`` master) gets a temporary folder; on a cluster it is an error, because
executors would each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Broadcasts above this many bytes are never asked for explicitly.
BROADCAST_LIMIT = 8 << 20

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="lodegraph-")
    return _local_root


def filesystem(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone already; the folder belongs to it
        pass


class Workspace:
    """A folder of intermediate tables that lives as long as the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/lodegraph/{name}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, *partition_by: str, metrics: dict | None = None) -> tuple[DataFrame, dict]:
        """Writes ``df`` once and reads it back; metrics are gathered during the write, without a second job."""
        seen = Observation()
        columns = [F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in (metrics or {}).items()]]
        df.observe(seen, *columns).write.mode("overwrite").partitionBy(*partition_by).parquet(self.path(name))
        return self.read(name, df), seen.get

    def append(self, df: DataFrame, name: str, column: str, value: int, metrics: dict | None = None) -> tuple[DataFrame, dict]:
        """Writes ``df`` as the partition ``column = value`` of table ``name``; returns that part and its metrics."""
        return self.write(df, f"{name}/{column}={value}", metrics=metrics)

    def whole(self, name: str, part: DataFrame, column: str) -> DataFrame:
        """All partitions of a table made by ``append``, in one scan; ``part`` is one of them."""
        return self.spark.read.schema(T.StructType([*part.schema.fields, T.StructField(column, T.IntegerType())])).parquet(self.path(name))

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def partitions(self, df: DataFrame) -> int:
        """Scan partitions of a table that was written here."""
        return df._jdf.queryExecution().toRdd().getNumPartitions()

    def drop(self, name: str) -> None:
        remove(self.spark, self.path(name))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``, an upper bound for scans with filters and projections."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A broadcast hint where the estimate proves the side small; otherwise the plain side, to be shuffled."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
