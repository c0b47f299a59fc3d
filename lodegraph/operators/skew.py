"""Per-key results over keys of which a few hold most rows: eager aggregation through joins.

Both inputs are aggregated by the join key (and the grouping columns) before they meet, so the join
sees one compact state per key instead of its rows; counts are then multiplied, sums scaled, and the
states rolled up to the wanted grouping.  The partial aggregates run before the shuffle, so a key with
a third of all rows sends one row per map task, not its rows.  Distinct counts group by the counted
value first, which spreads a hot key over as many groups as it has values.

Nulls: null keys and null grouping values form groups of their own in ``grouped_counts``; in a join
they meet nothing, as in SQL.  Counted values that are null are not counted.  Empty tables give an
empty result.  Columns of the two sides may share names: each side's measures are prefixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.storage import Workspace


def grouped_counts(df: DataFrame, by: list[str], distinct_of: str) -> DataFrame:
    """(by..., n_rows, n_distinct): rows and distinct non-null values per group, in two aggregation levels."""
    fine = df.groupBy(*by, F.col(distinct_of).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    return fine.groupBy(*by).agg(F.sum("_n").alias("n_rows"), F.count("_value").alias("n_distinct"))


def eager_join_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_by: list[str], right_by: list[str], distinct_of: str) -> DataFrame:
    """Counts over ``left JOIN right ON left_key = right_key`` per (left_by, right_by), without building the join.

    Returns left_by, right_by (prefixed ``right_``), left_rows and right_rows of the group's keys, joined_rows
    (the rows the join would have) and n_distinct of ``distinct_of`` on the left.
    Left states: one row per (key, left_by, counted value); right states: one row per (key, right_by).
    The left states are rolled up to one row per (key, left_by) before the join, so that the join reads
    compact rows on either side however many rows a key has.
    ``left_by`` must hold ``left_key``: then no value is counted in two keys of a group and distinct counts add up.
    """
    if left_key not in left_by:
        raise ValueError("left_by must hold the join key, or distinct counts would not add up")
    states = grouped_counts(left, left_by, distinct_of)
    others = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_key"), *[F.col(c).alias(f"right_{c}") for c in right_by]).agg(F.count(F.lit(1)).alias("_m"))
    met = states.join(others, states[left_key] == others["_key"], "left")
    return met.groupBy(*left_by, *[f"right_{c}" for c in right_by]).agg(
        F.sum("n_rows").alias("left_rows"),
        F.sum("n_distinct").alias("n_distinct"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.col("n_rows") * F.col("_m")), F.lit(0)).alias("joined_rows"),
    )


def pair_profile(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per (target, kind) of edges: rows, distinct sources, sightings of the target in nodes, and rows of the join."""
    out = eager_join_counts(edges, nodes, "target", "id", ["target", "kind"], [], "source")
    return out.select("target", "kind", F.col("left_rows").alias("n_rows"), F.col("n_distinct").alias("n_sources"), F.col("right_rows").alias("n_sightings"), F.col("joined_rows").alias("n_joined"))


def heavy_pairs(edges: DataFrame, nodes: DataFrame, parts: int = 100) -> DataFrame:
    """(target, kind) of the pairs with at least one in ``parts`` of all rows of ``edges``, compared in whole numbers.

    The joined profile is written once; the total of its rows is observed during that write, so neither input is read twice.
    """
    profile, seen = Workspace(edges.sparkSession, "skew").write(pair_profile(edges, nodes), "profile", metrics={"total": F.coalesce(F.sum("n_rows"), F.lit(0))})
    return profile.filter(F.col("n_rows") * parts >= seen["total"]).select("target", "kind")
