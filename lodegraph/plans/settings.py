"""Settings of a session: ``spark.lodegraph.<name>`` where it is set, else the default."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (default, least, most)
NUMBERS = {
    "ambiguityCeiling": (500, 1, 1_000_000_000),  # symbols of one name beyond which the name says nothing
    "debounceMillis": (2_000, 100, 60_000),  # quiet time that ends a burst of changes
    "impactDepth": (2, 1, 10),  # levels of an impact question
    "searchLimit": (100, 1, 1_000_000_000),
    "maxFileBytes": (1 << 20, 1, 1 << 40),  # larger files are listed, not read
}
#: name -> default
TEXTS = {"testGlob": ""}  # a glob that says what test files are, in place of the usual names


def number(spark: SparkSession, name: str) -> int:
    """A setting within its bounds."""
    default, least, most = NUMBERS[name]
    return min(most, max(least, int(spark.conf.get(f"spark.lodegraph.{name}", str(default)))))


def text(spark: SparkSession, name: str) -> str:
    return spark.conf.get(f"spark.lodegraph.{name}", TEXTS[name])
