import random
from collections import deque

from pyspark.sql import functions as F

from lodegraph.operators import search as S
from lodegraph.operators.adjacency import callers, file_dependencies
from lodegraph.operators.store import delete_files, identity_edges, valid_edges
from lodegraph.operators.traversal import cyclic, impact, levels, pagerank, shortest_paths


def pairs(spark, rows):
    return spark.createDataFrame(rows, "source string, target string")


def bfs(links, start, limit=None):
    out, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        if limit is not None and out[x] >= limit:
            continue
        for a, b in links:
            if a == x and b not in out:
                out[b] = out[x] + 1
                queue.append(b)
    return out


def test_levels_and_paths_on_random_graphs(spark):
    rng = random.Random(2)
    links = [(f"v{rng.randrange(25)}", f"v{rng.randrange(25)}") for _ in range(60)]
    got = levels(pairs(spark, links + links[:5]), spark.createDataFrame([("v0",), ("v1",)], "seed string"), 3).collect()
    assert {(r.seed, r.id): r.depth for r in got} == {(s, i): d for s in ("v0", "v1") for i, d in bfs(links, s, 3).items()}
    wanted = [(a, b) for a in ("v0", "v1") for b in (f"v{i}" for i in range(25))]
    found = {(r.from_id, r.to_id): (r.length, r.path) for r in shortest_paths(pairs(spark, links), spark.createDataFrame(wanted, "from_id string, to_id string")).collect()}
    assert {k: v[0] for k, v in found.items()} == {(a, b): bfs(links, a)[b] for a, b in wanted if b in bfs(links, a)}
    for (a, b), (n, path) in found.items():
        assert path[0] == a and path[-1] == b and len(path) == n + 1 and all((x, y) in links for x, y in zip(path, path[1:]))


def test_cycles(spark):
    rng = random.Random(4)
    links = [(f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for _ in range(42)] + [("s", "s"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]
    want = {a for a, _ in links if any(b == a or a in bfs(links, b) for x, b in links if x == a)}
    assert {r.id for r in cyclic(pairs(spark, links)).collect()} == want
    assert cyclic(pairs(spark, [("a", "b")])).collect() == []


def test_impact_pulls_members_at_their_containers_level(spark):
    nodes = spark.createDataFrame([("C", "class"), ("m", "method"), ("f", "function"), ("g", "function"), ("h", "function")], "id string, kind string")
    edges = spark.createDataFrame([("C", "m", "contains"), ("f", "m", "calls"), ("g", "f", "calls"), ("h", "g", "calls")], "source string, target string, kind string")
    seeds = spark.createDataFrame([("C",)], "seed string")
    assert {(r.id, r.depth) for r in impact(edges, nodes, seeds, 2).collect()} == {("C", 0), ("m", 0), ("f", 1), ("g", 2)}


def test_pagerank_sums_to_one_and_favours_the_target(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "d", "calls"), ("b", "d", "calls"), ("b", "d", "calls"), ("c", "a", "calls"), ("d", "x", "contains")], "source string, target string, kind string")
    rank = {r.id: r.pagerank for r in pagerank(nodes, edges).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and max(rank, key=rank.get) == "d"


def test_edge_identity_keeps_the_first_and_joins_drop_unknown_ends(spark):
    edges = spark.createDataFrame([(3, "a", "b", "calls", None, None, None), (2, "a", "b", "calls", None, None, None), (4, "a", "b", "calls", 1, None, None), (5, "a", "zz", "calls", 1, 1, None), (6, None, "b", "calls", 1, 1, None)], "id bigint, source string, target string, kind string, line int, col int, metadata string")
    assert {r.id for r in identity_edges(edges).collect()} == {2, 4, 5, 6}
    assert {r.id for r in valid_edges(edges, spark.createDataFrame([("a",), ("b",), (None,)], "id string")).collect()} == {2, 4}


def test_delete_cascades(spark):
    t = {
        "nodes": spark.createDataFrame([("a", "f"), ("b", "g")], "id string, file_path string"),
        "edges": spark.createDataFrame([("a", "b"), ("b", "b")], "source string, target string"),
        "refs": spark.createDataFrame([(1, "a"), (2, "b")], "ref_id int, from_node_id string"),
        "files": spark.createDataFrame([("f",), ("g",)], "path string"),
    }
    left = delete_files(t, spark.createDataFrame([("f",)], "path string"))
    assert {k: v.count() for k, v in left.items()} == {"nodes": 1, "edges": 1, "refs": 1, "files": 1}


def test_callers_and_file_dependencies(spark):
    links = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "references"), ("c", "b", "contains"), ("b", "a", "imports")], "source string, target string, kind string")
    assert {(r.node_id, r.caller_id, r.kind) for r in callers(links).collect()} == {("b", "a", "calls"), ("b", "a", "references"), ("a", "b", "imports")}
    nodes = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f1")], "id string, file_path string")
    assert {(r.path, r.depends_on) for r in file_dependencies(links, nodes).collect()} == {("f1", "f2"), ("f2", "f1")}


def test_query_parsing():
    q = S.parse_query('Counter kind:class lang:Python path:"src/a b" name:x weird:y kind:nope :z')
    assert (q.text, q.kinds, q.languages, q.paths, q.names) == ("Counter weird:y kind:nope :z", ["class"], ["python"], ["src/a b"], ["x"])
    assert S.terms("A::b AND 'x*' foo-bar") == ["a", "b", "x", "foo", "bar"]


def _symbols(spark, names):
    rows = [(f"id{i}", "class" if n[0].isupper() else "function", n, f"m::{n}", f"src/{n.lower()}.py", "python", None, None, i, 0) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, file_path string, language string, docstring string, signature string, start_line int, start_column int")


def test_search_stages(spark):
    nodes = _symbols(spark, ["Counter", "counter_value", "increment", "reset_counter_now", "Other"])
    first = S.search(nodes, "Counter").orderBy(F.desc("score")).first()
    assert first.name == "Counter"
    assert {r.name for r in S.search(nodes, "ncremen").collect()} == {"increment"}
    assert {r.name for r in S.search(nodes, "Countre").collect()} == {"Counter"}
    assert {r.name for r in S.search(nodes, "kind:class").collect()} == {"Counter", "Other"}
    assert S.search(nodes, "zzzzqqq").collect() == []
    assert {r.name for r in S.segment_seeds(nodes, "counter_now").collect()} == {"reset_counter_now"}
