"""Parent-child links to full hierarchies: path, depth, root, descendants and loops.

Level-wise frontier joins: round 0 settles the roots (parents that are nobody's child), round n + 1 the
children of what round n settled.  A child is settled once all its parents are; so a child that is met again
waits for its last parent, and a node that is never settled lies on a loop or hangs below one, also where a
root leads into the loop.  Every round is written as a table: the lineage stays one join deep, and the row
count that ends the loop is observed while writing.

Sizes: links are shuffled once by parent and kept partitioned.  Parents with many children are found by an
aggregate with map-side partials and their links are spread over ``SPLIT`` partitions each; the frontier row of
such a parent goes to all of them.  At most ``4 * width`` parents can be that heavy, so their list is broadcast.
A small frontier (nearly all deep ones) is broadcast by its file size.

Nulls: links with a null kind, source or target are ignored, as are links with an end that is not in
``nodes``.  Repeated links count once.  A child with several parents gets one row, under the parent that gives the
least (depth, root, parent).  A link from a node to itself is a loop.  Empty tables give an empty result.
Further columns of the inputs are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.traversal import cyclic
from lodegraph.plans.storage import Workspace, shuffle_width
from lodegraph.sources.tables import table

#: Edge kinds that form forests, with the column that names the parent.
PARENT_END = {"contains": "source", "extends": "target"}
#: A parent with at least so many children, and with more than a quarter of a partition's share, is spread over so many partitions.
HEAVY, SPLIT = 50_000, 32
LINK = ["kind", "parent"]


def parent_links(nodes: DataFrame, edges: DataFrame, parent_end: dict[str, str] = PARENT_END) -> DataFrame:
    """Distinct (kind, parent, child) of the kinds in ``parent_end`` whose ends both exist."""
    parent = reduce(lambda acc, kv: acc.when(F.col("kind") == kv[0], F.col(kv[1])), parent_end.items(), F.when(F.lit(False), F.col("source")))
    child = reduce(lambda acc, kv: acc.when(F.col("kind") == kv[0], F.col("target" if kv[1] == "source" else "source")), parent_end.items(), F.when(F.lit(False), F.col("source")))
    links = edges.filter(F.col("kind").isin(*parent_end)).select("kind", parent.alias("parent"), child.alias("child"))
    links = links.filter(F.col("parent").isNotNull() & F.col("child").isNotNull()).distinct()
    known = nodes.select(F.col("id")).filter(F.col("id").isNotNull()).distinct()
    # A parent may hold a third of all links: its existence is looked up once per distinct parent, not per link.
    parents = links.select("parent").distinct().join(known.withColumnRenamed("id", "parent"), "parent", "left_semi")
    return links.join(known.withColumnRenamed("id", "child"), "child", "left_semi").join(parents, "parent", "left_semi").select("kind", "parent", "child")


class _Split:
    """Links partitioned by parent, the children of heavy parents over several partitions."""

    def __init__(self, space: Workspace, links: DataFrame, parents: DataFrame, limit: int):
        width = shuffle_width(links.sparkSession)
        self.heavy, seen = space.write(parents.filter(F.col("n_children") >= limit).select(*LINK), "heavy")
        self.key = LINK
        if seen["rows"]:
            self.key = [*LINK, "part"]
            marked = links.join(F.broadcast(self.heavy.withColumn("is_heavy", F.lit(True))), LINK, "left")
            links = marked.withColumn("part", F.when(F.col("is_heavy"), F.pmod(F.xxhash64("child"), F.lit(SPLIT)).cast("int")).otherwise(0)).drop("is_heavy")
        # The partitioning survives in the cache, so no level shuffles the links again; a lost block is rebuilt from the written table.
        self.links = links.repartition(width, *self.key).persist()

    def children(self, frontier: DataFrame) -> DataFrame:
        """The frontier, its nodes as ``parent``, with a row per child."""
        step = frontier.withColumnRenamed("node_id", "parent")
        if "part" in self.key:
            step = step.join(F.broadcast(self.heavy.withColumn("is_heavy", F.lit(True))), LINK, "left")
            parts = F.when(F.col("is_heavy"), F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))
            step = step.withColumn("part", F.explode(parts)).drop("is_heavy")
        return step.join(self.links, self.key)


def hierarchies(links: DataFrame, with_paths: bool = True, heavy: int = HEAVY) -> DataFrame:
    """(kind, node_id, root_id, depth[, path]) of every node in ``links``; loops as root '' and depth -1.

    ``path`` lists the ids from the root to the node, both included; it is null where depth is -1.
    """
    spark = links.sparkSession
    space = Workspace(spark, "hierarchy")
    links, seen = space.write(links, "links")
    limit = max(heavy, seen["rows"] // (4 * shuffle_width(spark)))
    parents, _ = space.write(links.groupBy(*LINK).agg(F.count(F.lit(1)).alias("n_children")), "parents")
    several, met_again = space.write(links.groupBy("kind", "child").agg(F.count(F.lit(1)).alias("n_parents")).filter("n_parents > 1"), "several")
    single = links.join(several.select("kind", "child"), ["kind", "child"], "left_anti") if met_again["rows"] else links
    split = _Split(space, single, parents, limit)
    shared = _Split(Workspace(spark, "shared"), links.join(several, ["kind", "child"]), parents, limit) if met_again["rows"] else None
    rows = ["kind", "node_id", "root_id", "depth", *(["path"] if with_paths else [])]
    longer = [F.concat("path", F.array("child")).alias("path")] if with_paths else []
    start = parents.select(*LINK).join(links.select("kind", F.col("child").alias("parent")), LINK, "left_anti")
    level = start.select("kind", F.col("parent").alias("node_id"), F.col("parent").alias("root_id"), F.lit(0).alias("depth"), *([F.array("parent").alias("path")] if with_paths else []))
    frontier, seen = space.append(level, "reached", "round", 0)
    n = 0
    while seen["rows"]:
        n += 1
        step = split.children(frontier).select("kind", F.col("child").alias("node_id"), "root_id", (F.col("depth") + 1).alias("depth"), *longer)
        if shared:
            # A child of several parents waits: what has arrived is counted, and the last parent settles it.
            came, _ = space.append(shared.children(frontier).select("kind", "child", "parent", "n_parents", "root_id", (F.col("depth") + 1).alias("depth"), *longer), "arrived", "round", n)
            arrived = space.whole("arrived", came, "round").groupBy("kind", "child")
            best = F.min_by(F.struct("root_id", "depth", *rows[4:]), F.struct("depth", "root_id", "parent")).alias("b")
            ready = arrived.agg(F.count(F.lit(1)).alias("n"), F.max("n_parents").alias("n_parents"), F.max("round").alias("last"), best).filter((F.col("n") == F.col("n_parents")) & (F.col("last") == n))
            step = step.unionByName(ready.select("kind", F.col("child").alias("node_id"), *[f"b.{c}" for c in rows[2:]]))
        frontier, seen = space.append(step.select(*rows), "reached", "round", n)
    for part in (split, shared):
        if part:
            part.links.unpersist()
    reached = space.whole("reached", frontier, "round").select(*rows)
    everyone = links.select("kind", F.explode(F.array("parent", "child")).alias("node_id")).distinct()
    lost = everyone.join(reached.select("kind", "node_id"), ["kind", "node_id"], "left_anti")
    nothing = [F.lit(None).cast("array<string>").alias("path")] if with_paths else []
    return reached.unionByName(lost.select("kind", "node_id", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), *nothing))


def descendants(tree: DataFrame) -> DataFrame:
    """(kind, ancestor_id, node_id, distance): one row per ancestor pair, from the paths of ``hierarchies``.

    Descendants stay rows; a root above a third of all nodes is never gathered into one value.
    """
    steps = tree.filter("depth > 0").select("kind", "node_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return steps.filter("at < depth").select("kind", "ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))


def loop_members(links: DataFrame, tree: DataFrame) -> DataFrame:
    """(kind, node_id) of the nodes on a loop itself, among those that no root settles.

    Where each of them has one parent, nodes without children are peeled off level by level, and loops stay.  Where some have
    several, what stays can also lead from loop to loop, and the cyclic nodes are sought instead.
    """
    spark = links.sparkSession
    space = Workspace(spark, "loops")
    lost = tree.filter("depth = -1").select("kind", "node_id")
    inner = links.join(lost.withColumnRenamed("node_id", "child"), ["kind", "child"], "left_semi").join(lost.withColumnRenamed("node_id", "parent"), LINK, "left_semi")
    inner, seen = space.write(inner.select("kind", "parent", "child"), "round=0")
    _, several = space.write(inner.groupBy("kind", "child").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several")
    if several["rows"]:
        name = lambda c: F.concat_ws("\x00", "kind", c)
        found = cyclic(inner.select(name("parent").alias("source"), name("child").alias("target")))
        parts = F.split("id", "\x00", 2)
        return found.select(parts[0].alias("kind"), parts[1].alias("node_id"))
    before, n = -1, 0
    while seen["rows"] != before:
        before, n = seen["rows"], n + 1
        inner, seen = space.write(inner.join(inner.select("kind", F.col("parent").alias("child")).distinct(), ["kind", "child"], "left_semi"), f"round={n}")
    return inner.select("kind", F.col("child").alias("node_id")).distinct()


def project_links(spark: SparkSession, folder: str) -> DataFrame:
    return parent_links(table(spark, folder, "nodes"), table(spark, folder, "edges"))
