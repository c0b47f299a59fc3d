import random
from collections import Counter, defaultdict

import pytest
from lodegraph.operators.skew import eager_join_counts, heavy_pairs, pair_profile

EDGES = "id bigint, source string, target string, kind string, n_rows int, _key string"


def test_profile_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), "hot" if rng.random() < 0.4 else f"t{rng.randrange(20)}", rng.choice(["calls", "imports"])) for _ in range(2000)]
    rows += [(None, "t1", "calls"), ("a", None, "calls"), ("a", "t2", None)] + rows[:50]
    nodes = [f"t{i}" for i in range(10)] + ["t1", "hot", None]
    edges = spark.createDataFrame([(i, *r, 7, "clash") for i, r in enumerate(rows)], EDGES)
    seen_nodes = spark.createDataFrame([(n, "clash") for n in nodes], "id string, kind string")
    got = pair_profile(edges, seen_nodes)
    count, sources, seen = Counter((t, k) for _, t, k in rows), defaultdict(set), Counter(n for n in nodes if n)
    for s, t, k in rows:
        if s is not None:
            sources[(t, k)].add(s)
    assert {(r.target, r.kind): (r.n_rows, r.n_sources, r.n_sightings, r.n_joined) for r in got.collect()} == {p: (n, len(sources[p]), seen[p[0]], n * seen[p[0]]) for p, n in count.items()}
    heavy = heavy_pairs(edges, seen_nodes)
    assert {(r.target, r.kind) for r in heavy.collect()} == {p for p, n in count.items() if n >= 0.01 * len(rows)}


def test_empty_and_wrong_grouping(spark):
    edges = spark.createDataFrame([], EDGES)
    assert pair_profile(edges, spark.createDataFrame([], "id string")).collect() == []
    assert heavy_pairs(edges, spark.createDataFrame([], "id string")).collect() == []
    with pytest.raises(ValueError):
        eager_join_counts(edges, edges, "target", "source", ["kind"], [], "source")
