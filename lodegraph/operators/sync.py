"""An index of a project from its texts, and its maintenance file by file, equal to a rebuild.

``build`` extracts symbols, containment and references, and resolves the references.  ``sync`` takes the files whose content
differs, replaces their rows, and resolves again exactly the references whose answer can differ: those of the replaced files,
and those that share a key (name, last or first segment, without case) with a symbol that came, went or changed.
All sets are DataFrames that meet by semi- and anti-joins; a small change is broadcast by its size.

``ProjectIndex`` keeps the tables in a folder: every version beside the last, swapped by the state log's rename, with
a marker that says that resolution is under way.  Where it is found set, the run before died, and all references are
resolved again.

Nulls: texts without path are ignored, null texts are files without symbols.  Empty tables give empty results.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.paths import language_of
from lodegraph.operators.resolve import last_segment, resolve, resolved_edges
from lodegraph.plans.storage import Workspace, filesystem, remove
from lodegraph.sources.extract import extract

Tables = dict[str, DataFrame]
TABLES = ("files", "nodes", "refs", "resolved")


def _symbols(texts: DataFrame) -> Tables:
    """files, nodes and refs of the texts; containment is the nodes' ``parent_id``."""
    rows = extract(texts)
    language = language_of(F.col("file_path"))
    nodes = rows.filter("what = 'node'").select("id", "kind", "name", "qualified_name", "file_path", language.alias("language"), "start_line", F.lit(0).alias("start_column"), "end_line", F.lit(None).cast("int").alias("is_exported"), "parent_id").dropDuplicates(["id"])
    key = F.xxhash64("parent_id", "reference_name", "reference_kind", "start_line", "file_path")
    refs = rows.filter("what = 'ref'").select(key.alias("ref_id"), F.col("parent_id").alias("from_node_id"), "reference_name", "reference_kind", F.col("start_line").alias("line"), F.lit(0).alias("col"), "file_path", language.alias("language")).dropDuplicates(["ref_id"])
    files = texts.filter("path is not null").select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")).dropDuplicates(["path"])
    return {"files": files, "nodes": nodes, "refs": refs}


def build(texts: DataFrame) -> Tables:
    """files, nodes, refs and resolved (ref_id, target, confidence, resolved_by) from scratch."""
    space = Workspace(texts.sparkSession, "build")
    made = {name: space.write(df, name)[0] for name, df in _symbols(texts).items()}
    return made | {"resolved": space.write(resolve(made["refs"], made["nodes"]), "resolved")[0]}


def edges(tables: Tables) -> DataFrame:
    """(source, target, kind, line): containment and the edges of resolved references."""
    inside = tables["nodes"].filter("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.col("start_line").alias("line"))
    found = resolved_edges(tables["refs"], tables["nodes"], tables["resolved"]).select("source", "target", "kind", "line")
    return inside.unionByName(found)


def changed_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed, by content hash."""
    now = texts.filter("path is not null").select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_now")).dropDuplicates(["path"])
    met = files.select("path", "content_hash").join(now, "path", "full_outer")
    change = F.when(F.col("content_hash").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("content_hash") != F.col("_now"), "changed")
    return met.select("path", change.alias("change")).filter("change is not null")


def _keys(*names: Column) -> Column:
    parts = [p for n in names for p in (n, last_segment(n), F.regexp_extract(n, "^([^./:]+)", 1), F.element_at(F.split(n, "/"), -1))]
    return F.array_distinct(F.filter(F.array(*[F.lower(p) for p in parts]), lambda k: k.isNotNull() & (k != "")))


def sync(tables: Tables, texts: DataFrame, whole: bool = False) -> tuple[Tables, dict[str, int]]:
    """The tables brought up to ``texts``, and how many files, symbols and references were touched; ``whole`` resolves every reference again."""
    space = Workspace(texts.sparkSession, "sync")
    changed, files_seen = space.write(changed_files(tables["files"], texts), "changed")
    touched = changed.select("path")
    fresh = {name: space.write(df, f"fresh-{name}")[0] for name, df in _symbols(texts.join(touched, "path", "left_semi")).items()}
    at = {"files": "path", "nodes": "file_path", "refs": "file_path"}
    kept = {name: tables[name].join(touched.withColumnRenamed("path", column), column, "left_anti") for name, column in at.items()}
    gone = tables["nodes"].join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    # Symbols that came, went or changed: what is in one of the two sets only, row by row.
    columns = ["id", "kind", "name", "qualified_name", "file_path", "language", "start_line"]
    both = gone.select(*columns, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(fresh["nodes"].select(*columns, F.lit(0).alias("_old"), F.lit(1).alias("_new")))
    moved, symbols_seen = space.write(both.groupBy(*columns).agg(F.sum("_old").alias("o"), F.sum("_new").alias("n")).filter("o <> n").select("name", "qualified_name", "file_path"), "moved")
    keys = moved.select(F.explode(_keys(F.col("name"), F.col("qualified_name"), F.col("file_path"))).alias("key")).distinct()
    out = {name: space.write(kept[name].select(*fresh[name].columns).unionByName(fresh[name]), name)[0] for name in at}
    if whole:
        scope, refs_seen = space.write(out["refs"].select("ref_id"), "scope")
    else:
        met = kept["refs"].select("ref_id", F.explode(_keys(F.col("reference_name"))).alias("key")).join(keys, "key", "left_semi").select("ref_id")
        scope, refs_seen = space.write(met.unionByName(fresh["refs"].select("ref_id")).distinct(), "scope")
    again = resolve(out["refs"].join(scope, "ref_id", "left_semi"), out["nodes"])
    held = tables["resolved"].join(scope, "ref_id", "left_anti").join(out["refs"].select("ref_id"), "ref_id", "left_semi")
    out["resolved"], _ = space.write(held.select("ref_id", "target", "confidence", "resolved_by").unionByName(again.select("ref_id", "target", "confidence", "resolved_by")), "resolved")
    return out, {"files": files_seen["rows"], "symbols": symbols_seen["rows"], "refs": refs_seen["rows"]}


def differing(a: Tables, b: Tables) -> DataFrame:
    """(part, n_rows, n_differing): per table how many rows are in one of the two only, repeated rows counted."""
    out = None
    for part in ("files", "nodes", "edges"):
        x, y = (edges(t) if part == "edges" else t[part] for t in (a, b))
        both = x.select(*x.columns, F.lit(1).alias("_x")).unionByName(y.select(*x.columns, F.lit(-1).alias("_x")))
        apart = both.groupBy(*x.columns).agg(F.sum("_x").alias("d"), F.count(F.when(F.col("_x") == -1, 1)).alias("n"))
        row = apart.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("n_differing")).select(F.lit(part).alias("part"), "n_rows", "n_differing")
        out = row if out is None else out.unionByName(row)
    return out


class Metadata:
    """Named values beside an index, one small file each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def get(self, key: str) -> str | None:
        fs, p = filesystem(self.spark, f"{self.root}/meta/{key}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(stream.readLine())
        finally:
            stream.close()

    def set(self, key: str, value: str) -> None:
        fs, p = filesystem(self.spark, f"{self.root}/meta/{key}")
        out = fs.create(p, True)
        out.writeBytes(json.dumps(value) + "\n")
        out.close()

    def delete(self, key: str) -> None:
        fs, p = filesystem(self.spark, f"{self.root}/meta/{key}")
        fs.delete(p, False)


INCOMPLETE = "resolution_incomplete"


class ProjectIndex:
    """The tables of a project in a folder, built once and then kept up."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.meta = spark, root.rstrip("/"), Metadata(spark, root)

    def read(self) -> Tables:
        version = self.meta.get("version")
        if version is None:
            raise LookupError(f"no index at {self.root}")
        return {name: self.spark.read.parquet(f"{self.root}/{version}/{name}") for name in TABLES}

    def _publish(self, tables: Tables) -> None:
        version, before = f"v-{uuid.uuid4().hex}", self.meta.get("version")
        for name in TABLES:
            tables[name].write.parquet(f"{self.root}/{version}/{name}")
        self.meta.set("version", version)
        if before:
            remove(self.spark, f"{self.root}/{before}")

    def build(self, texts: DataFrame) -> None:
        self._publish(build(texts))
        self.meta.delete(INCOMPLETE)

    def sync(self, texts: DataFrame) -> dict[str, int]:
        """Brings the index up to ``texts``; returns what was touched.  A run that died before is made good."""
        broken = self.meta.get(INCOMPLETE) is not None
        self.meta.set(INCOMPLETE, "1")
        tables, touched = sync(self.read(), texts, whole=broken)
        self._publish(tables)
        self.meta.delete(INCOMPLETE)
        return touched
