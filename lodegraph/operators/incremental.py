"""Processing only new or changed records, exactly once, over failing runs.

The state (key -> content hash, time of the last record that counted) is a versioned table of a base and the
deltas of the runs since:

    <root>/base-<id>/    the state at some version, one row per key
    <root>/delta-<id>/   what one run changed: the keys whose record counted, with their case (what the run publishes)
    <root>/log/<n>       version n as one line of JSON: its base and deltas, the run that made it, its delta

A run reads the version in force, writes its delta beside it, and then swaps versions by one atomic step: the log
entry n + 1 is renamed into place, which fails where another run has made n + 1 in the meantime.  A run that dies
earlier leaves files no one refers to; the next run takes the same records again, because its input is
"everything delivered since the run named in the log".  A run that is repeated after its swap does nothing.  Runs
come from sources (a batch schedule, a stream with its checkpoint); each source counts its own runs, so a stream
that lost its checkpoint starts a new source and its repeated records change nothing.

Scale: a run writes the rows it changes, not the state.  The state is read for the keys of the run only (a semi-join,
which Catalyst turns into a broadcast filter for a small run); after ``COMPACT`` deltas they are merged into a new base.

Records: (key, hash, seen_at, ord).  Rows with a null key, hash or seen_at are ignored; hashes are
compared in lower case; per key only the row with the greatest (seen_at, ord) counts, and only if it is
later than the time in the state.  Repeated rows therefore change nothing.  A key without state is new.
Keys are aggregated before the shuffle, so a key with many deliveries is no hot spot.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.plans.storage import Workspace, filesystem, remove
from lodegraph.sources.tables import newest, table

STATE = "key string, hash string, seen_at bigint"
DELTA = STATE + ", case string"
#: Deltas after which they are merged into a new base.
COMPACT = 16


class Overtaken(RuntimeError):
    """Another run has swapped the version this run started from; nothing of this run is in force."""


def last_records(rows: DataFrame) -> DataFrame:
    """(key, hash, seen_at): the record that counts per key."""
    rows = rows.filter("key is not null and hash is not null and seen_at is not null")
    best = rows.groupBy("key").agg(F.max(F.struct("seen_at", "ord", F.lower("hash").alias("hash"))).alias("_b"))
    return best.select("key", F.col("_b.hash").alias("hash"), F.col("_b.seen_at").alias("seen_at"))


def step(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The records that count against ``state``: (key, hash, seen_at, case), case in new | changed | null (a later time alone)."""
    old = state.select("key", F.col("hash").alias("_h"), F.col("seen_at").alias("_t"))
    met = last_records(rows).join(old, "key", "left").filter(F.col("_t").isNull() | (F.col("seen_at") > F.col("_t")))
    case = F.when(F.col("_h").isNull(), "new").when(F.col("hash") != F.col("_h"), "changed")
    return met.select("key", "hash", "seen_at", case.alias("case"))


class VersionedState:
    """The state table under ``root`` and its atomic swap."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _entry(self) -> dict:
        """The log entry in force."""
        fs, folder = filesystem(self.spark, f"{self.root}/log")
        versions = [int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()] if fs.exists(folder) else []
        if not versions:
            return {"version": -1, "state": [], "last": {}}
        stream = fs.open(filesystem(self.spark, f"{self.root}/log/{max(versions):010d}")[1])
        try:
            return json.loads(stream.readLine())
        finally:
            stream.close()

    def current(self, source: str = "batch") -> tuple[int, int | None]:
        """(version in force, last run of ``source`` in it); version -1 before the first, run None before the source's first."""
        entry = self._entry()
        return entry["version"], entry["last"].get(source)

    def _rows(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(STATE).parquet(*folders) if folders else self.spark.createDataFrame([], STATE)
        # Times grow with every delta that holds a key.
        return rows if len(folders) < 2 else rows.groupBy("key").agg(F.max(F.struct("seen_at", "hash")).alias("b")).select("key", "b.hash", "b.seen_at")

    def read(self) -> DataFrame:
        return self._rows(self._entry()["state"])

    def outputs(self) -> DataFrame:
        """(run, source, key, case): what all runs published, in one scan per delta folder still listed in the log."""
        fs, folder = filesystem(self.spark, f"{self.root}/log")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], "run int, source string, key string, case string")
        log = self.spark.read.schema("run int, source string, delta string").json(f"{self.root}/log").filter("delta is not null")
        folders = [r.delta for r in log.select("delta").collect()]  # one row per run
        if not folders:
            return self.spark.createDataFrame([], "run int, source string, key string, case string")
        rows = self.spark.read.schema(DELTA).parquet(*folders).filter("case is not null")
        named = rows.select("key", "case", F.regexp_extract(F.input_file_name(), "(delta-[0-9a-f]+)", 1).alias("_d"))
        log = log.select("run", "source", F.regexp_extract("delta", "(delta-[0-9a-f]+)", 1).alias("_d"))
        return named.join(log, "_d").select("run", "source", "key", "case")

    def _swap(self, entry: dict) -> None:
        """Puts ``entry`` into force as the next version, or raises ``Overtaken`` if that version exists."""
        jvm = self.spark.sparkContext._jvm
        fs, new = filesystem(self.spark, f"{self.root}/_{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.writeBytes(json.dumps(entry) + "\n")
        out.close()
        place = filesystem(self.spark, f"{self.root}/log/{entry['version']:010d}")[1]
        fs.mkdirs(place.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(new, place, options)
        except Exception as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Overtaken(f"version {entry['version']} was made by another run") from None
            raise

    def start(self, state: DataFrame) -> None:
        """Version 0 from an existing index; does nothing where a version is in force."""
        if self._entry()["version"] < 0:
            base = f"{self.root}/base-{uuid.uuid4().hex}"
            state.select("key", F.lower("hash").alias("hash"), "seen_at").write.parquet(base)
            self._swap({"version": 0, "state": [base], "last": {}, "run": None, "source": None, "delta": None})

    def process(self, run: int, rows: DataFrame, fail_before_swap: bool = False, source: str = "batch") -> DataFrame:
        """The cases of ``run`` (key, case), published and recorded exactly once."""
        entry = self._entry()
        done = entry["last"].get(source)
        if done is not None and done >= run:
            return self.outputs().filter((F.col("run") == run) & (F.col("source") == source)).select("key", "case")
        delta = f"{self.root}/delta-{uuid.uuid4().hex}"
        keys = rows.filter("key is not null and hash is not null and seen_at is not null").select("key").distinct()
        old = self.spark.read.schema(STATE).parquet(*entry["state"]).join(keys, "key", "left_semi") if entry["state"] else self.read()
        if len(entry["state"]) > 1:
            old = old.groupBy("key").agg(F.max(F.struct("seen_at", "hash")).alias("b")).select("key", "b.hash", "b.seen_at")
        step(old, rows).write.parquet(delta)
        folders, merged = [*entry["state"], delta], []
        if len(folders) > COMPACT:
            base = f"{self.root}/base-{uuid.uuid4().hex}"
            self._rows(folders).write.parquet(base)
            folders, merged = [base], entry["state"]
        if fail_before_swap:
            raise RuntimeError("run ended before its swap")
        self._swap({"version": entry["version"] + 1, "state": folders, "last": entry["last"] | {source: run}, "run": run, "source": source, "delta": delta})
        for folder in merged:
            if "/base-" in folder:  # merged bases have no reader but runs that will be overtaken; deltas stay as what runs published
                remove(self.spark, folder)
        return self.spark.read.schema(DELTA).parquet(delta).filter("case is not null").select("key", "case")


def due_runs(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """``scans`` with ``due_run``: the first successful run at or after the run a row was delivered to; others dropped.

    ``runs`` (run_id, status) is the log of runs.  Each run id that occurs is mapped to its due run by a window over the
    ids alone (one row per run), and the rows meet the mapping by their id.
    """
    ids = runs.filter("run_id is not null").groupBy("run_id").agg(F.max(F.when(F.col("status") == "ok", F.col("run_id"))).alias("ok"))
    ids = ids.unionByName(scans.filter("run_id is not null").select("run_id").distinct().withColumn("ok", F.lit(None).cast("int")))
    ids = ids.groupBy("run_id").agg(F.max("ok").alias("ok"))
    ahead = Window.orderBy("run_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    due = ids.select("run_id", F.min("ok").over(ahead).cast("int").alias("due_run")).filter("due_run is not null")
    return scans.join(due, "run_id")


def replay(spark: SparkSession, scans: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, path, case) of every successful run over the index ``files``."""
    space = Workspace(spark, "incremental")
    state = VersionedState(spark, space.path("state"))
    known = newest(files.select("path", "content_hash", "indexed_at").filter("indexed_at is not null"), "path", [F.col("indexed_at")])
    state.start(known.select(F.col("path").alias("key"), F.col("content_hash").alias("hash"), F.col("indexed_at").alias("seen_at")))
    named = due_runs(scans, runs.select("run_id", "status")).select("due_run", F.col("path").alias("key"), F.col("content_hash").alias("hash"), F.col("observed_at").alias("seen_at"), F.col("scan_id").alias("ord"))
    named, _ = space.write(named, "deliveries", "due_run")
    # The loop is over runs, which follow one another by nature; what it holds is one number per run.
    for (run,) in sorted(runs.filter("status = 'ok' and run_id is not null").select("run_id").distinct().collect()):
        state.process(run, named.filter(F.col("due_run") == run))
    return state.outputs().select(F.col("run").alias("run_id"), F.col("key").alias("path"), "case")


def project_replay(spark: SparkSession, folder: str) -> DataFrame:
    return replay(spark, table(spark, folder, "scans"), table(spark, folder, "runs"), table(spark, folder, "files"))
