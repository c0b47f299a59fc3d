"""Functions paired with their documentation (code-description pairs).

Files are cut into islands (documentation, annotations, signature, balanced body) once each; symbols of the
index meet them by (path, name), the nearest island to the indexed line winning.  An island gives the pair its
code, the signature where the index has none (its parameter names tell nothing when they are restated), and its
documentation where the index has none that tells anything.  Documentation is reduced to what it tells; functions
of which neither the newest sighting nor the source tells anything are dropped.

Scale: symbols shrink to one row per id before their shuffle (``max_by`` with map-side partials); texts are
parsed where they are read, and only the islands travel.  A file with very many functions is one array value
per (path, name), never per path.

Nulls and edges: rows with a null id are ignored; a null or empty docstring counts as none; a null name or path
keeps the row with null code, as do symbols without an island (files that do not parse, unknown languages,
missing texts).  Ties in updated_at go to the greater row as text.  Repeated rows count once.  Empty tables give
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.doctext import telling
from lodegraph.llm.islands import islands
from lodegraph.sources.tables import newest

ISLANDS = "path string, name string, found array<struct<start_line:int,end_line:int,doc:string,signature:string,code:string>>"


def file_islands(texts: DataFrame, signatures_only: bool = False) -> DataFrame:
    """One row per (path, name): every function of that name in the file; with ``signatures_only`` without documentation and code, which then need not travel."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                named: dict[str, list] = {}
                for i in islands(path, text):
                    named.setdefault(i.name, []).append((i.start_line, i.end_line, *((None, i.signature, None) if signatures_only else (i.doc, i.signature, i.code))))
                rows += [(path, name, found) for name, found in named.items()]
            yield pd.DataFrame(rows, columns=["path", "name", "found"])

    return texts.filter("path is not null and text is not null").select("path", "text").mapInPandas(parse, ISLANDS)


@F.pandas_udf(T.StringType())
def told(docstring: pd.Series, name: pd.Series, signature: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([telling(d, n, s, g) if d else "" for d, n, s, g in zip(docstring, name, signature, language)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("description", T.StringType()), T.StructField("by", T.StringType())]))
def told_by(docstring: pd.Series, doc: pd.Series, name: pd.Series, signature: pd.Series, language: pd.Series) -> pd.DataFrame:
    """What the indexed documentation tells, else what the source's does; ('', null) if neither does."""
    rows = []
    for indexed, source, n, s, g in zip(docstring, doc, name, signature, language):
        said = telling(indexed, n, s, g) if indexed else ""
        if said:
            rows.append((said, "index"))
        else:
            said = telling(source, n, s, g) if source else ""
            rows.append((said, "source" if said else None))
    return pd.DataFrame(rows, columns=["description", "by"])


def functions(nodes: DataFrame) -> DataFrame:
    """The newest sighting of every function and method."""
    latest = newest(nodes, "id", [F.col("updated_at")], ["kind", "name", "file_path", "language", "start_line", "end_line", "docstring", "signature"])
    return latest.filter(F.col("kind").isin("function", "method"))


def with_islands(symbols: DataFrame, texts: DataFrame, signatures_only: bool = False) -> DataFrame:
    """``symbols`` with ``island``, the nearest function of their name in their file, and the signature that holds."""
    met = symbols.join(file_islands(texts, signatures_only).withColumnRenamed("name", "_name"), (F.col("file_path") == F.col("path")) & (F.col("name") == F.col("_name")), "left")
    fields = lambda i: F.struct(F.coalesce(F.abs(i["start_line"] - F.col("start_line")), F.lit(0)).alias("far"), i["start_line"].alias("at"), i["end_line"].alias("end"), i["signature"].alias("signature"), i["doc"].alias("doc"), i["code"].alias("code"))
    met = met.withColumn("island", F.array_min(F.transform("found", fields))).drop("found", "path", "_name")
    return met.withColumn("signature", F.coalesce("signature", "island.signature"))


def indexed_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The functions whose indexed documentation tells something, with ``description``."""
    documented = functions(nodes).filter(F.length(F.trim("docstring")) > 0)
    return with_islands(documented, texts, signatures_only=True).withColumn("description", told("docstring", "name", "signature", "language")).filter("description <> ''")


def code_description_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, kind, name, language, path, start_line, end_line, signature, description, documented_by, docstring, code, same_span).

    ``documented_by`` is 'index' where the newest docstring tells something, else 'source'.
    """
    met = with_islands(functions(nodes), texts)
    # Each text is judged once: a filter on a deterministic function would be pushed below the projection and evaluate it again.
    met = met.withColumn("_told", told_by.asNondeterministic()("docstring", "island.doc", "name", "signature", "language")).filter("_told.by is not null")
    by_index = F.col("_told.by") == "index"
    return met.select(
        "id", "kind", "name", "language", "file_path",
        F.coalesce("island.at", "start_line").alias("start_line"), F.coalesce("island.end", "end_line").alias("end_line"),
        "signature", F.col("_told.description").alias("description"), F.col("_told.by").alias("documented_by"),
        F.when(by_index, F.col("docstring")).otherwise(F.col("island.doc")).alias("docstring"), F.col("island.code").alias("code"),
        (F.col("island.at").eqNullSafe(F.col("start_line")) & F.col("island.end").eqNullSafe(F.col("end_line"))).alias("same_span"),
    )
