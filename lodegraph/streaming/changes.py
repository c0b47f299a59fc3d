"""The incremental operators on streams: debounced bursts and change detection, with results equal to the batch forms.

Event times are epoch milliseconds in the tables; they become timestamps for the watermark.  Late rows beyond the
watermark are dropped, as the watermark promises; with ``availableNow`` over a finished folder the batch result
comes out.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.incremental import VersionedState
from lodegraph.plans.settings import number
from lodegraph.plans.storage import filesystem

SCANS = "scan_id bigint, run_id int, path string, content_hash string, size bigint, modified_at bigint, observed_at bigint"


def scan_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(SCANS).parquet(folder)


def debounced(stream: DataFrame, quiet_ms: int | None = None, lateness: str = "1 hour") -> DataFrame:
    """(path, first_seen, last_seen, n_events) per burst: a session window whose gap is the quiet time (the session's setting, 100 ms to 60 s)."""
    gap = f"{number(stream.sparkSession, 'debounceMillis') if quiet_ms is None else min(60_000, max(100, quiet_ms))} milliseconds"
    rows = stream.filter("path is not null and modified_at is not null").withColumn("at", F.timestamp_millis("modified_at"))
    return rows.withWatermark("at", lateness).groupBy("path", F.session_window("at", gap)).agg(F.min("modified_at").alias("first_seen"), F.max("modified_at").alias("last_seen"), F.count(F.lit(1)).alias("n_events")).select("path", "first_seen", "last_seen", "n_events")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that owns a checkpoint folder; a lost folder gives a new id, hence a new source of runs."""
    fs, p = filesystem(spark, f"{checkpoint.rstrip('/')}/metadata")
    stream = fs.open(p)
    try:
        return json.loads(stream.readLine())["id"]
    finally:
        stream.close()


def process_stream(stream: DataFrame, state: VersionedState, checkpoint: str, on_cases=None):
    """Each micro-batch is one run over the versioned state; a batch that is replayed after a failure changes nothing twice.

    Runs are counted per checkpoint: where it is lost, the stream reads everything again as a new source, and the
    state's hashes and times keep what was processed from being a case once more.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.col("path").alias("key"), F.col("content_hash").alias("hash"), F.col("observed_at").alias("seen_at"), F.col("scan_id").alias("ord"))
        cases = state.process(epoch, rows, source=stream_id(state.spark, checkpoint))
        if on_cases is not None:
            on_cases(cases, epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
