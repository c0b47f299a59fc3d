"""The queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.docpairs import code_description_pairs, indexed_pairs
from lodegraph.llm.handwritten import not_handwritten, patterns_in_use
from lodegraph.llm.leakage import leaked_passages
from lodegraph.llm.packing import containers, placed, summary
from lodegraph.llm.residue import with_residue
from lodegraph.llm.validity import rates, verdicts
from lodegraph.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """By the indexed documentation, as the problem states it; islands give the signatures that the index lacks."""
    return indexed_pairs(table(spark, folder, "nodes"), table(spark, folder, "file_texts")).select("id")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return code_description_pairs(table(spark, folder, "nodes"), table(spark, folder, "file_texts"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(table(spark, folder, "files"), table(spark, folder, "file_texts")).select("path")


def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    found = not_handwritten(table(spark, folder, "files"), table(spark, folder, "file_texts"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


def p4_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return patterns_in_use(table(spark, folder, "files"), table(spark, folder, "file_texts"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(table(spark, folder, "file_texts")).filter("not valid").select("path")


def p5_errors(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(table(spark, folder, "file_texts")).filter("not valid").select("path", "language", "n_errors", "first_line", "first_cause")


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rates(verdicts(table(spark, folder, "file_texts")))


def p7_bins(spark: SparkSession, folder: str) -> DataFrame:
    return placed(containers(table(spark, folder, "documents")))


def p7_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary(containers(table(spark, folder, "documents")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_passages(spark, folder).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return with_residue(table(spark, folder, "documents").select("doc_id", "text")).filter("residue is not null").select("doc_id")


def p9_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kinds = with_residue(table(spark, folder, "documents").select("doc_kind", "text"))
    return kinds.groupBy("doc_kind", F.coalesce("residue", F.lit("content")).alias("residue")).agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p4_found, p4_reasons, p4_patterns, p5_found, p5_errors, p5_rates, p7_bins, p7_summary, p8_found, p8_passages, p9_found, p9_kinds)}
SQL: dict[str, str] = {}
