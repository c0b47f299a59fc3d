"""Readers of the project tables, and the newest state of tables that hold several sightings of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def newest(df: DataFrame, key: str, order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``; rows with a null key are left out.

    An aggregate with ``max_by`` rather than a window: rows shrink before the shuffle, so a key that
    holds many sightings is no hot spot.  Ties between unequal rows go to the row with the greater hash,
    whatever the order of the input.
    """
    columns = columns or [c for c in df.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    best = F.max_by(row, F.struct(*order, F.xxhash64(*[F.col(f"`{c}`") for c in columns])))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_row")).select(key, *[F.col("_row").getField(c).alias(c) for c in columns])
