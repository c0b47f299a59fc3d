import random

from lodegraph.operators import hierarchy
from lodegraph.operators.hierarchy import descendants, hierarchies, loop_members, parent_links

NODES = "id string, path string, depth int"
EDGES = "id bigint, source string, target string, kind string, parent string, root_id int"


def expected(links):
    """(kind, node) -> (root, depth, path); loops and what hangs below them as ('', -1, None)."""
    parents = {(k, c): p for k, p, c in links}
    out = {}
    for k, p, c in links:
        for n in (p, c):
            path, seen = [n], {n}
            while (k, path[0]) in parents:
                up = parents[(k, path[0])]
                if up in seen:
                    path = None
                    break
                seen.add(up)
                path.insert(0, up)
            out[(k, n)] = (path[0], len(path) - 1, path) if path else ("", -1, None)
    return out


def build(spark, nodes, edges):
    return spark.createDataFrame([(n, "x", 1) for n in nodes], NODES), spark.createDataFrame([(i, s, t, k, "clash", 0) for i, (s, t, k) in enumerate(edges)], EDGES)


def test_random_forests_with_loops(spark):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(120)]
    links = set()
    for kind in ("contains", "extends"):
        for i, n in enumerate(nodes):
            if rng.random() < 0.8:
                links.add((kind, nodes[rng.randrange(0, max(1, i))] if rng.random() < 0.93 else rng.choice(nodes), n))
    links = {(k, p, c) for k, p, c in links}
    edges = [(p, c, k) if k == "contains" else (c, p, k) for k, p, c in links]
    edges += edges[:20] + [("n1", "gone", "contains"), (None, "n2", "contains"), ("n3", None, "extends"), ("n4", "n5", None), ("n1", "n2", "calls")]
    n, e = build(spark, nodes + nodes[:5] + [None], edges)
    found = parent_links(n, e)
    tree = hierarchies(found).collect()
    want = expected(links)
    assert {(r.kind, r.node_id): (r.root_id, r.depth, r.path) for r in tree} == want
    assert len(tree) == len(want)
    pairs = {(r.kind, r.ancestor_id, r.node_id, r.distance) for r in descendants(hierarchies(found)).collect()}
    assert pairs == {(k, a, n, d - i) for (k, n), (_, d, path) in want.items() if path for i, a in enumerate(path[:-1])}


def test_self_link_and_loop_members(spark):
    n, e = build(spark, list("abcdef"), [("a", "a", "contains"), ("b", "c", "contains"), ("c", "b", "contains"), ("c", "d", "contains"), ("e", "f", "contains")])
    links = parent_links(n, e)
    tree = hierarchies(links, with_paths=False)
    assert {(r.node_id, r.root_id, r.depth) for r in tree.collect()} == {("a", "", -1), ("b", "", -1), ("c", "", -1), ("d", "", -1), ("e", "e", 0), ("f", "e", 1)}
    assert {r.node_id for r in loop_members(links, tree).collect()} == {"a", "b", "c"}


def test_hot_parent_and_empty_tables(spark):
    nodes = [f"c{i}" for i in range(3000)] + ["hub"]
    n, e = build(spark, nodes, [("hub", f"c{i}", "contains") for i in range(3000)])
    rows = hierarchies(parent_links(n, e), with_paths=False).groupBy("root_id", "depth").count().collect()
    assert {(r.root_id, r.depth, r["count"]) for r in rows} == {("hub", 0, 1), ("hub", 1, 3000)}
    n, e = build(spark, [], [])
    assert hierarchies(parent_links(n, e)).collect() == []


def test_loop_below_a_root_and_several_parents(spark):
    # r leads into the loop a -> b -> a; d has two parents of one tree, e one settled and one looped parent
    links = [("r", "a"), ("a", "b"), ("b", "a"), ("r", "c"), ("r", "x"), ("x", "y"), ("c", "d"), ("y", "d"), ("d", "f"), ("b", "e"), ("c", "e"), ("e", "g")]
    n, e = build(spark, list("rabcdefgxy"), [(p, c, "contains") for p, c in links])
    found = parent_links(n, e)
    tree = hierarchies(found)
    got = {r.node_id: (r.root_id, r.depth, r.path and "".join(r.path)) for r in tree.collect()}
    assert got == {"r": ("r", 0, "r"), "c": ("r", 1, "rc"), "x": ("r", 1, "rx"), "y": ("r", 2, "rxy"), "d": ("r", 2, "rcd"), "f": ("r", 3, "rcdf"), **dict.fromkeys("abeg", ("", -1, None))}
    assert tree.count() == 10
    assert {r.node_id for r in loop_members(found, tree).collect()} == {"a", "b"}


def test_random_graphs_settle_what_no_loop_leads_to(spark):
    rng = random.Random(4)
    for _ in range(3):
        links = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(36)}
        parents = {}
        for p, c in links:
            parents.setdefault(c, set()).add(p)
        everyone = {x for link in links for x in link}
        depth = {x: 0 for x in everyone if x not in parents}
        while True:
            more = {x: 1 + min(depth[p] for p in parents[x]) for x in everyone if x not in depth and all(p in depth for p in parents[x])}
            if not more:
                break
            depth |= more
        n, e = build(spark, sorted(everyone), [(p, c, "contains") for p, c in links])
        got = {r.node_id: r.depth for r in hierarchies(parent_links(n, e), with_paths=False).collect()}
        assert got == {x: depth.get(x, -1) for x in everyone}


def test_heavy_parents_are_spread(spark):
    nodes = [f"c{i}" for i in range(2000)] + ["hub", "top"] + [f"d{i}" for i in range(50)]
    n, e = build(spark, nodes, [("top", "hub", "contains")] + [("hub", f"c{i}", "contains") for i in range(2000)] + [(f"c{i}", f"d{i}", "contains") for i in range(50)])
    links = parent_links(n, e)
    tree = hierarchies(links, heavy=100).collect()
    assert len(tree) == 2052 and {(r.root_id, r.depth) for r in tree if r.node_id.startswith("c")} == {("top", 2)} and {r.depth for r in tree if r.node_id.startswith("d")} == {3}
    space = hierarchy.Workspace(spark, "test")
    split = hierarchy._Split(space, links, links.groupBy("kind", "parent").count().withColumnRenamed("count", "n_children"), 100)
    sizes = [len(x) for x in split.links.rdd.glom().collect()]
    assert max(sizes) < 1200 and split.links.select("part").distinct().count() == hierarchy.SPLIT
    split.links.unpersist()
