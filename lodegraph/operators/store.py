"""The tables as the graph sees them, and their mutations as DataFrame operations.

Nodes: the newest sighting per id.  Edges: both ends exist, one per (source, target, kind, line, col) with nulls
equal, the first inserted.  Files: the newest state per path.  References keep their multiplicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources.tables import newest, table

NODE = ["kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "start_column", "end_column", "docstring", "signature", "visibility", "return_type", "is_exported", "is_async", "is_static", "is_abstract"]


def latest_nodes(nodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return newest(nodes, "id", [F.col("updated_at")], columns or NODE)


def latest_files(files: DataFrame) -> DataFrame:
    return newest(files, "path", [F.col("indexed_at")], ["content_hash", "language", "size", "modified_at", "indexed_at", "node_count", "errors", "generated"])


def identity_edges(edges: DataFrame) -> DataFrame:
    """First edge per identity; lines and columns as stored."""
    key = ["source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("_line"), F.coalesce("col", F.lit(-1)).alias("_col")]
    first = edges.groupBy(*key).agg(F.min_by(F.struct("id", "line", "col", "metadata"), "id").alias("_e"))
    return first.select("_e.id", "source", "target", "kind", "_e.line", "_e.col", "_e.metadata")


def existing(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``columns`` all name a node.  Each distinct value is looked up once, so a hot end costs one probe."""
    known = ids.select("id").distinct()
    for c in columns:
        present = df.select(c).distinct().join(known.withColumnRenamed("id", c), c, "left_semi")
        df = df.join(present, c, "left_semi")
    return df


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return existing(identity_edges(edges), nodes.filter("id is not null"), "source", "target")


def simple_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (source, target, kind) whose ends exist: enough for reachability, and smaller before its shuffle."""
    return existing(edges.select("source", "target", "kind").distinct(), nodes.filter("id is not null"), "source", "target")


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files in ``paths`` (path): nodes of the file, edges at those nodes, references from them."""
    nodes = tables["nodes"]
    gone = nodes.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id").distinct()
    edges = tables["edges"].join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return {
        "nodes": nodes.join(gone, "id", "left_anti"),
        "edges": edges,
        "refs": tables["refs"].join(gone.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_anti"),
        "files": tables["files"].join(paths, "path", "left_anti"),
    }


class Graph:
    """The project tables of a folder, each built once per use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def nodes(self, *columns: str) -> DataFrame:
        return latest_nodes(self.raw("nodes"), list(columns) or None)

    def files(self) -> DataFrame:
        return latest_files(self.raw("files"))

    def edges(self) -> DataFrame:
        return valid_edges(self.raw("edges"), self.raw("nodes"))

    def links(self, *kinds: str) -> DataFrame:
        edges = self.raw("edges")
        return simple_edges(edges.filter(F.col("kind").isin(*kinds)) if kinds else edges, self.raw("nodes"))

    def refs(self) -> DataFrame:
        return existing(self.raw("refs"), self.raw("nodes").filter("id is not null"), "from_node_id")
