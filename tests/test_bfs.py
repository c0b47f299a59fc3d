import random

from lodegraph.operators.traversal import bfs
from lodegraph.plans.storage import Workspace

NODES, LINKS = "id string, kind string", "source string, target string, kind string"


def expected(nodes, links, seeds, depth, kinds, refused, direction, limit):
    """The whole levels of every seed in plain Python, cut at the end."""
    taken = {i for i, kind in nodes if not refused or (kind and kind not in refused)}
    near = {}
    for a, b, kind in links:
        for s, t in {"out": [(a, b)], "in": [(b, a)], "both": [(a, b), (b, a)]}[direction] if not kinds or kind in kinds else []:
            if t in taken:
                near.setdefault(s, {}).setdefault(t, set()).add({"contains": 0, "calls": 1}.get(kind, 2))
    rows = []
    for seed in seeds:
        seen, frontier = [(0, 0, seed)], {seed}
        for d in range(1, depth + 1):
            old, best = {x[2] for x in seen}, {}
            for s in frontier:
                for t, priorities in near.get(s, {}).items():
                    if t not in old:
                        best[t] = min([*priorities, best.get(t, 2)])
            seen += [(d, p, t) for t, p in best.items()]
            frontier = set(best)
        rows += [(seed, t, d, k) for k, (d, p, t) in enumerate(sorted(seen), 1) if k <= limit]
    return sorted(rows)


def test_limited_levels_are_the_whole_levels_cut_at_the_end(spark):
    rng = random.Random(7)
    ids = [f"n{i:02}" for i in range(40)]
    nodes = [(i, rng.choice(["class", "method", "file", None])) for i in ids]
    ends = [*ids, *ids[:3] * 6, "nowhere"]  # a few hubs, and an end that is no node
    links = [(rng.choice(ends), rng.choice(ends), rng.choice(["contains", "calls", "extends", "imports"])) for _ in range(150)]
    seeds = [*ids[:12], "alone"]
    tables = spark.createDataFrame(links, LINKS), spark.createDataFrame(nodes, NODES), spark.createDataFrame([(i,) for i in seeds], "seed string")
    for case in [(2, ["contains", "calls", "extends"], ["file"], "both", 4), (3, None, ["file"], "both", 9), (3, None, None, "in", 5), (2, None, ["method", "file"], "out", 6), (4, ["calls"], None, "out", 1000), (2, None, None, "both", 1), (0, None, None, "out", 3)]:
        assert sorted(map(tuple, bfs(*tables, *case).collect())) == expected(nodes, links, seeds, *case), case


def test_what_is_written_grows_with_the_limit_and_not_with_hubs(spark, monkeypatch):
    seeds = [f"s{i:02}" for i in range(20)]
    leaves = [f"x{i:03}" for i in range(300)]
    nodes = [(i, "class") for i in [*seeds, *leaves, "hub"]]
    links = [(s, "hub", "calls") for s in seeds] + [("hub", x, "calls") for x in leaves]
    written, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda *a, **k: (done := write(*a, **k), written.append(done[1]["rows"]))[0])
    got = bfs(spark.createDataFrame(links, LINKS), spark.createDataFrame(nodes, NODES), spark.createDataFrame([(s,) for s in seeds], "seed string"), 2, direction="both", limit=5)
    assert sorted(map(tuple, got.collect())) == expected(nodes, links, seeds, 2, None, None, "both", 5)
    assert max(written) <= 5 * len(seeds)
