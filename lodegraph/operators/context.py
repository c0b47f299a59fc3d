"""Context around search results: what to read for a question, and the types its signatures speak of."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.adjacency import CALL_KINDS
from lodegraph.operators.search import sum_or

# What can be called, what a signature names, and which edges say so.
CALLABLE_KINDS = ("function", "method", "component")
TYPE_KINDS = ("class", "struct", "interface", "trait", "protocol", "enum", "type_alias")
SIGNATURE_EDGES = ("type_of", "returns", "references")


def query_terms(text: str) -> list[str]:
    """Words of three letters or more, lower case, once each."""
    return list(dict.fromkeys(w for w in re.findall(r"[a-z0-9]+", text.lower()) if len(w) >= 3))


def caller_tiers(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(seed_set, id, n_callers): of each set's callable seeds the first, and those with at least a quarter of the most callers.

    ``seeds`` is (seed_set, id, rank), callables only.
    """
    called = links.filter(F.col("kind").isin(*CALL_KINDS)).select(F.col("target").alias("id"), "source", "kind").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    counted = seeds.join(called, "id", "left").withColumn("n_callers", F.coalesce("n", F.lit(0)))
    most = counted.groupBy("seed_set").agg(F.floor(F.max("n_callers") / 4).alias("least"), F.min("rank").alias("first"))
    return counted.join(most, "seed_set").filter((F.col("rank") == F.col("first")) | (F.col("n_callers") >= F.col("least"))).select("seed_set", "id", "n_callers")


def explore(nodes: DataFrame, links: DataFrame, seeds: DataFrame, text: str) -> DataFrame:
    """(id, role): seeds (id, rank) of a question with their callers, callees and members, and the types rescued from their signatures.

    A type is rescued if a tiered seed's signature names it, it lies in no seed's file, and the question itself hardly names
    it (fewer than two terms in its path or name).  Roles: seed before near before rescued.
    """
    call = F.col("kind").isin(*CALL_KINDS)
    ids = seeds.select("id")
    into = links.filter(call).join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    out = links.filter(call | (F.col("kind") == "contains")).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    callable_seeds = seeds.join(nodes.filter(F.col("kind").isin(*CALLABLE_KINDS)).select("id"), "id", "left_semi").select(F.lit(0).alias("seed_set"), "id", "rank")
    tiered = caller_tiers(callable_seeds, links).select(F.col("id").alias("source"))
    named = links.filter(F.col("kind").isin(*SIGNATURE_EDGES)).join(tiered, "source", "left_semi").select(F.col("target").alias("id")).distinct()
    seed_files = nodes.join(ids, "id", "left_semi").select("file_path").distinct()
    types = nodes.filter(F.col("kind").isin(*TYPE_KINDS)).join(named, "id", "left_semi").join(ids, "id", "left_anti").join(seed_files, "file_path", "left_anti")
    hits = F.lit(0)
    for t in query_terms(text):
        hits = hits + F.when(sum_or(F.contains(F.lower("file_path"), F.lit(t)), F.contains(F.lower("name"), F.lit(t))), 1).otherwise(0)
    rescued = types.filter(hits < 2).select("id", F.lit(2).alias("r"))
    every = ids.withColumn("r", F.lit(0)).unionByName(into.unionByName(out).withColumn("r", F.lit(1))).unionByName(rescued)
    best = every.groupBy("id").agg(F.min("r").alias("r"))
    return best.select("id", F.element_at(F.array(F.lit("seed"), F.lit("near"), F.lit("rescued")), F.col("r") + 1).alias("role"))
