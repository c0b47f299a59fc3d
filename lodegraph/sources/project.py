"""A project tree as a table of (path, text), and the tables written back for a later run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.paths import LANGUAGE_OF, extension, ignored


def scan_project(spark: SparkSession, root: str, ignore: list[str] | None = None, include: list[str] | None = None, max_bytes: int = 1 << 20) -> DataFrame:
    """(path, text, size, modified_at, message): the extractable files under ``root`` with relative paths.

    Patterns in ``ignore`` fold in order, the last match wins; ``include`` patterns force a file back, also out of a folder that is
    skipped by default.  A file over ``max_bytes`` keeps its row with a null text and a message.  Files of other extensions
    are left out while listing, and contents of large files are not read: both conditions are the reader's own.
    """
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*" + re.escape(base.lstrip("/")), "")

    def listed(condition: str, *columns: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(sorted({*LANGUAGE_OF, *(e.upper() for e in LANGUAGE_OF)})) + "}").load(root).filter(condition)
        out = files.select(path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), *columns)
        skip = ignored(F.col("path"), ignore or [])
        if include:
            skip = skip & ignored(F.col("path"), ["*", *["!" + p for p in include]], [])
        return out.filter(~skip & extension(F.col("path")).isin(*LANGUAGE_OF))

    small = listed(f"length <= {max_bytes}", "content").select("path", F.decode("content", "UTF-8").alias("text"), "size", "modified_at", F.lit(None).cast("string").alias("message"))
    large = listed(f"length > {max_bytes}").select("path", F.lit(None).cast("string").alias("text"), "size", "modified_at", F.lit("file exceeds the size limit").alias("message"))
    return small.unionByName(large)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def export_node_links(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Node-link export as JSON lines, distributed: nulls are dropped per row."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/links")
