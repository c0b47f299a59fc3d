"""One step in the graph: callers, callees, usages, children, and the dependencies between files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL_KINDS = ("calls", "references", "imports")
CONTAINERS = ("class", "interface", "struct", "trait", "protocol", "enum", "module", "namespace")


def callers(links: DataFrame) -> DataFrame:
    """(node_id, caller_id, kind): one row per caller and kind of every node."""
    return links.filter(F.col("kind").isin(*CALL_KINDS)).select(F.col("target").alias("node_id"), F.col("source").alias("caller_id"), "kind").distinct()


def callees(links: DataFrame) -> DataFrame:
    return links.filter(F.col("kind").isin(*CALL_KINDS)).select(F.col("source").alias("node_id"), F.col("target").alias("callee_id"), "kind").distinct()


def file_dependencies(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, depends_on): distinct pairs of files with an edge between their nodes, containment aside."""
    where = nodes.select("id", "file_path")
    pairs = links.filter("kind <> 'contains'").select("source", "target").distinct()
    met = pairs.join(where.withColumnRenamed("id", "source").withColumnRenamed("file_path", "path"), "source").join(where.withColumnRenamed("id", "target").withColumnRenamed("file_path", "depends_on"), "target")
    return met.filter("path <> depends_on").select("path", "depends_on").distinct()


def reference_sites(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, from_node_id, line, col): sites outside a file that point into it; a null coordinate makes both null (whole-file fallback)."""
    where = nodes.select("id", "file_path")
    met = edges.filter("kind <> 'contains'").join(where.withColumnRenamed("id", "target").withColumnRenamed("file_path", "path"), "target")
    met = met.join(where.withColumnRenamed("id", "source").withColumnRenamed("file_path", "from_path"), "source").filter("path <> from_path")
    whole = F.col("line").isNull() | F.col("col").isNull()
    at = lambda c: F.when(~whole, F.col(c)).alias(c)
    return met.select("path", F.col("source").alias("from_node_id"), at("line"), at("col")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) over the edges given, parallel ones counted, 0 where there are none."""
    ends = edges.filter("kind <> 'contains'")
    into = ends.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = ends.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def strongest(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows per group with their rank; the partial limit runs before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
