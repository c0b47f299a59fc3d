import random

import pytest

from lodegraph.operators import incremental
from lodegraph.operators.incremental import Overtaken, VersionedState, due_runs, replay

SCANS = "scan_id bigint, run_id int, path string, content_hash string, size bigint, modified_at bigint, observed_at bigint, key string, case string"
FILES = "path string, content_hash string, indexed_at bigint, hash string, seen_at int"
RUNS = "run_id int, started_at bigint, status string"


def expected(scans, runs, files):
    known = {}
    for path, h, t in files:
        if path is not None and t is not None and (path not in known or t > known[path][1]):
            known[path] = (h and h.lower(), t)
    out, before = set(), -1
    for run, status in sorted(runs):
        if status != "ok":
            continue
        best = {}
        for sid, r, path, h, seen in scans:
            if r is not None and before < r <= run and None not in (path, h, seen):
                best[path] = max(best.get(path, (-1, -1, "")), (seen, sid, h.lower()))
        for path, (seen, _, h) in best.items():
            if path not in known or seen > known[path][1]:
                if path not in known or known[path][0] is None or known[path][0] != h:
                    out.add((run, path))
                known[path] = (h, seen)
        before = run
    return out


def frames(spark, scans, runs, files):
    s = spark.createDataFrame([(a, b, c, d, 1, 1, e, "clash", "clash") for a, b, c, d, e in scans], SCANS)
    return s, spark.createDataFrame([(r, 0, st) for r, st in runs], RUNS), spark.createDataFrame([(p, h, t, "clash", 1) for p, h, t in files], FILES)


def test_replay_against_brute_force(spark):
    rng = random.Random(3)
    runs = [(1, "ok"), (2, "failed"), (3, "ok"), (4, "killed"), (5, "ok"), (6, "running")]
    paths = [f"p{i}" for i in range(30)] + [None]
    scans = [(i, rng.choice([1, 2, 3, 4, 5, 6]), rng.choice(paths), rng.choice(["aa", "AA", "bb", "Bb", None]), rng.choice([10, 20, 30, 40, 50, None])) for i in range(300)]
    scans += [(1000 + i, *s[1:]) for i, s in enumerate(scans[:40])]
    files = [(p, rng.choice(["aa", "BB", None]), rng.choice([5, 15, 25])) for p in paths[:20]] * 2
    files = list({(p, t): (p, h, t) for p, h, t in files}.values()) + [(None, "aa", 1)]
    out = replay(spark, *frames(spark, scans, runs, files)).collect()
    assert {(r.run_id, r.path) for r in out} == expected(scans, runs, files)
    assert len(out) == len({(r.run_id, r.path) for r in out})


def test_empty_tables(spark):
    assert replay(spark, *frames(spark, [], [], [])).collect() == []
    assert replay(spark, *frames(spark, [], [(1, "ok")], [])).collect() == []


def test_failure_before_the_swap_repeats_and_a_repeated_run_does_nothing(spark, tmp_path):
    state = VersionedState(spark, f"file://{tmp_path}/state")
    rows = spark.createDataFrame([("a", "AA", 10, 1), ("a", "bb", 10, 2), ("b", "cc", 5, 3), (None, "x", 1, 4), ("c", None, 1, 5)], "key string, hash string, seen_at bigint, ord bigint")
    state.start(spark.createDataFrame([("b", "CC", 1)], "key string, hash string, seen_at bigint"))
    with pytest.raises(RuntimeError):
        state.process(1, rows, fail_before_swap=True)
    assert state.current() == (0, None)
    assert {(r.key, r.case) for r in state.process(1, rows).collect()} == {("a", "new")}
    assert {(r.key, r.hash, r.seen_at) for r in state.read().collect()} == {("a", "bb", 10), ("b", "cc", 5)}
    before = state.current()
    assert {(r.key, r.case) for r in state.process(1, rows).collect()} == {("a", "new")}
    assert state.current() == before
    later = spark.createDataFrame([("a", "dd", 10, 9), ("b", "ee", 6, 9)], "key string, hash string, seen_at bigint, ord bigint")
    assert {(r.key, r.case) for r in state.process(2, later).collect()} == {("b", "changed")}


def test_due_runs(spark):
    scans = spark.createDataFrame([(r,) for r in range(1, 6)], "run_id int")
    log = spark.createDataFrame([(1, "ok"), (3, "ok"), (4, "killed"), (5, "running"), (None, "ok")], "run_id int, status string")
    got = {r.run_id: r.due_run for r in due_runs(scans, log).collect()}
    assert got == {1: 1, 2: 3, 3: 3}  # run 2 is in no log: its rows fall to the next successful run


def test_two_runs_at_once_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 3)
    state = VersionedState(spark, f"file://{tmp_path}/state")
    record = lambda *rows: spark.createDataFrame([(k, h, t, 1) for k, h, t in rows], "key string, hash string, seen_at bigint, ord bigint")
    state.process(1, record(("a", "x", 1)))
    stale = state._entry()
    state.process(2, record(("b", "y", 2)))
    with pytest.raises(Overtaken):
        state._swap(stale | {"version": stale["version"] + 1})
    assert state.current() == (1, 2)
    for run in range(3, 9):
        state.process(run, record(("a", f"x{run}", run), ("b", "y", run)))
    assert {(r.key, r.hash, r.seen_at) for r in state.read().collect()} == {("a", "x8", 8), ("b", "y", 8)}
    assert len(state._entry()["state"]) <= 3
    assert sorted((r.run, r.key, r.case) for r in state.outputs().collect()) == [(1, "a", "new"), (2, "b", "new"), *[(r, "a", "changed") for r in range(3, 9)]]


def test_sources_count_their_own_runs(spark, tmp_path):
    state = VersionedState(spark, f"file://{tmp_path}/state")
    rows = spark.createDataFrame([("a", "x", 1, 1)], "key string, hash string, seen_at bigint, ord bigint")
    assert [r.case for r in state.process(5, rows, source="s1").collect()] == ["new"]
    assert state.process(0, rows, source="s2").collect() == []  # a stream that lost its checkpoint starts at 0 and repeats
    more = spark.createDataFrame([("a", "y", 2, 1)], "key string, hash string, seen_at bigint, ord bigint")
    assert [r.case for r in state.process(1, more, source="s2").collect()] == ["changed"]
