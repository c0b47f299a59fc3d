"""Level-synchronous traversal: breadth-first levels, shortest paths, impact, affected files, cycles.

Every level is one join of the frontier with the links, one anti-join with what is visited, and one write; the
written level cuts the lineage, and its observed row count ends the loop.  Frontiers hold each node once per
seed.  Depth-limited results are by shortest distance, so no result depends on the order in which edges are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.plans.storage import Workspace, shuffle_width


def levels(links: DataFrame, seeds: DataFrame, max_depth: int | None = None, expand: Column | None = None) -> DataFrame:
    """(seed, id, depth, pred): nodes reached from each seed over (source, target), the seed itself at depth 0.

    ``expand`` says which reached ids may be expanded (over column ``id``).  ``pred`` is the smallest predecessor on a
    shortest path.
    """
    space = Workspace(links.sparkSession, "levels")
    links, _ = space.write(links.select("source", "target").distinct(), "links")
    # The partitioning survives in the cache, so no level shuffles the links; a lost block is rebuilt from the written table.
    links = links.repartition(shuffle_width(links.sparkSession), "source").persist()
    start = seeds.select("seed", F.col("seed").alias("id"), F.lit(None).cast("string").alias("pred")).distinct()
    frontier, seen = space.append(start, "reached", "depth", 0)
    depth = 0
    while seen["rows"] and (max_depth is None or depth < max_depth):
        depth += 1
        open_ = frontier.filter(expand) if expand is not None else frontier
        found = open_.select("seed", F.col("id").alias("source")).join(links, "source").select("seed", F.col("target").alias("id"), F.col("source").alias("pred"))
        found = found.groupBy("seed", "id").agg(F.min("pred").alias("pred"))
        visited = space.whole("reached", frontier, "depth").select("seed", "id")
        frontier, seen = space.append(found.join(visited, ["seed", "id"], "left_anti").select("seed", "id", "pred"), "reached", "depth", depth)
    links.unpersist()
    return space.whole("reached", frontier, "depth").select("seed", "id", "depth", "pred")


def reversed_links(links: DataFrame) -> DataFrame:
    return links.select(F.col("target").alias("source"), F.col("source").alias("target"))


def bfs(links: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int, edge_kinds: list[str] | None = None, refuse_kinds: list[str] | None = None, direction: str = "out", limit: int = 1000) -> DataFrame:
    """(seed, id, depth, rank): breadth-first levels over (source, target, kind) with the options of a traversal.

    ``direction`` is out, in or both.  Nodes of ``refuse_kinds``, and ends that are not in ``nodes``, are neither taken nor passed; a
    seed is never refused.  Per seed the first ``limit`` nodes are kept, by depth, then by the edge that reached them (containment,
    calls, others), then by id, so that the limit does not depend on the order in which edges are read.

    The first ``limit`` neighbours of a node in that order are all that can matter: what comes before a kept node among the neighbours of
    the one that reached it is either nearer to the seed or itself kept before it, so it is fewer than ``limit``.  By the same count a seed with
    ``limit`` nodes goes no further.  So hubs are short lists, and no level holds more than ``limit`` squared candidates per seed.
    """
    spark = links.sparkSession
    space, width = Workspace(spark, "bfs"), shuffle_width(spark)
    kept = (links.filter(F.col("kind").isin(*edge_kinds)) if edge_kinds else links).filter("source <> target")
    kept = kept.select("source", "target", F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2).alias("priority"))
    ahead, back = F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target"))
    turn = lambda *ways: kept.select(F.inline(F.array(*ways)), "priority").repartition(width, "source")
    near = turn(*{"out": [ahead], "in": [back], "both": [ahead, back]}[direction])
    # Both ways, the links seen from their targets are the same rows in the same places; only those that are refused move again.
    seen_from_target = near if direction == "both" else turn({"out": back, "in": ahead}[direction])
    taken = nodes.filter(~F.col("kind").isin(*refuse_kinds)) if refuse_kinds else nodes
    # An outer join, not an anti join: that one is pushed below the shuffle, which is then not shared.
    refused = seen_from_target.join(taken.select(F.col("id").alias("source"), F.lit(True).alias("taken")), "source", "left").filter("taken is null")
    # Below every priority, so that the least one tells what is refused.
    refused = refused.select(F.col("target").alias("source"), F.col("source").alias("target"), (F.col("priority") - 3).alias("priority"))
    near = near.unionByName(refused.repartition(width, "source")).groupBy("source", "target").agg(F.min("priority").alias("priority")).filter("priority >= 0")
    order = Window.partitionBy("source").orderBy("priority", "target")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("source", "target", "priority").persist()
    # place: depth * 3 + priority; size: nodes of the seed so far.
    state = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("place"), F.lit(1).alias("rank"), F.lit(1).alias("size")).distinct()
    order = Window.partitionBy("seed").orderBy("place", "id")
    for depth in range(1, max_depth + 1):
        open_ = state.filter((F.col("place") >= 3 * (depth - 1)) & (F.col("size") < limit)).select("seed", F.col("id").alias("source"))
        found = open_.join(near, "source").select("seed", F.col("target").alias("id"), (F.col("priority") + 3 * depth).alias("place"))
        found = state.select("seed", "id", "place").unionByName(found).repartition(width, "seed").groupBy("seed", "id").agg(F.min("place").alias("place"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).withColumn("size", F.max("rank").over(Window.partitionBy("seed")))
        state, seen = space.write(found, f"depth={depth}", metrics={"new": F.count(F.when(F.col("place") >= 3 * depth, 1))})
        space.drop(f"depth={depth - 1}")
        if not seen["new"]:
            break
    near.unpersist()
    return state.filter(F.col("rank") <= limit).select("seed", "id", F.expr("cast(place div 3 as int)").alias("depth"), "rank")


def shortest_paths(links: DataFrame, pairs: DataFrame, max_length: int | None = None) -> DataFrame:
    """(from_id, to_id, length, path): unweighted shortest paths of the (from_id, to_id) pairs that are connected; the smallest predecessor wins ties."""
    reach = levels(links, pairs.select(F.col("from_id").alias("seed")), max_length)
    spark = links.sparkSession
    space = Workspace(spark, "paths")
    found = reach.select("seed", "id", "depth", "pred")
    state = pairs.join(found, (pairs.from_id == found.seed) & (pairs.to_id == found.id)).select("from_id", "to_id", F.col("depth").alias("length"), F.col("pred").alias("at"), F.array("to_id").alias("path"))
    state, seen = space.write(state, "step=0", metrics={"open": F.count("at")})
    n = 0
    while seen["open"]:
        n += 1
        met = state.join(found, (state["from_id"] == found["seed"]) & (state["at"] == found["id"]), "left")
        state, seen = space.write(met.select("from_id", "to_id", "length", F.col("pred").alias("at2"), F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "path")).otherwise(F.col("path")).alias("path")).withColumnRenamed("at2", "at"), f"step={n}", metrics={"open": F.count("at")})
    return state.select("from_id", "to_id", "length", "path")


def impact(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, id, depth): what depends on each seed.  Reverse edges other than containment cost one level; the members of a
    container come at the container's own level, however deep containers nest.

    The members of all containers are walked down once, so that a level is one join with reverse edges and one with members; both
    are shuffled by their source once and kept so, and what is reached is one table, read in one scan per step.
    """
    from lodegraph.operators.adjacency import CONTAINERS

    spark = edges.sparkSession
    space, width = Workspace(spark, "impact"), shuffle_width(spark)
    containers = nodes.filter(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("source"))
    inside = edges.filter("kind = 'contains'").select("source", "target").distinct().join(containers, "source", "left_semi")
    members = levels(inside, inside.select(F.col("source").alias("seed")).distinct()).filter("depth > 0").select(F.col("seed").alias("source"), F.col("id").alias("target"))
    back, _ = space.write(reversed_links(edges.filter("kind <> 'contains'").select("source", "target").distinct()), "back")
    members, back = (x.repartition(width, "source").persist() for x in (members, back))
    newest, seen = seeds.select("seed", F.col("seed").alias("id")).distinct(), {"rows": 1}
    reached = None
    for depth in range(max_depth + 1):
        step = lambda links: newest.select("seed", F.col("id").alias("source")).join(links, "source").select("seed", F.col("target").alias("id"))  # noqa: B023, E731
        if depth:
            found, _ = space.write(step(back).distinct().join(reached.select("seed", "id"), ["seed", "id"], "left_anti"), f"found={depth}")
            newest = found
        whole = newest.unionByName(step(members)).distinct()
        if reached is not None:
            whole = whole.join(reached.select("seed", "id"), ["seed", "id"], "left_anti")
        newest, seen = space.append(whole.select("seed", "id"), "reached", "depth", depth)
        reached = space.whole("reached", newest, "depth")
        if not seen["rows"]:
            break
    members.unpersist()
    back.unpersist()
    return reached.select("seed", "id", "depth")


def cyclic(links: DataFrame) -> DataFrame:
    """(id) of the vertices on a directed cycle of (source, target).

    Vertices without incoming or outgoing links are trimmed until none are left; then the greatest id is spread
    forward until it stands, and each root's colour is walked backward: what meets is a strongly connected component.
    """
    spark = links.sparkSession
    space = Workspace(spark, "cycles")
    alive, seen = space.write(links.select("source", "target").distinct(), "links")
    found, turn = [], 0
    found.append(alive.filter("source = target").select(F.col("source").alias("id")))
    alive, seen = space.write(alive.filter("source <> target"), "proper")
    while seen["rows"]:
        turn += 1
        before, n = -1, 0
        while seen["rows"] != before and seen["rows"]:
            before, n = seen["rows"], n + 1
            heads = alive.select(F.col("target").alias("source")).distinct()
            tails = alive.select(F.col("source").alias("target")).distinct()
            alive, seen = space.write(alive.join(heads, "source", "left_semi").join(tails, "target", "left_semi").select("source", "target"), f"trim={turn}-{n}")
        if not seen["rows"]:
            break
        color, state = space.write(alive.select(F.col("source").alias("id"), F.col("source").alias("color")).distinct(), f"color={turn}-0")
        n, changed = 0, 1
        while changed:
            n += 1
            spread = alive.join(color.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max("color").alias("best"))
            step = color.join(spread, "id", "left").select("id", F.greatest("color", F.coalesce("best", "color")).alias("color"), (F.coalesce("best", "color") > F.col("color")).alias("moved"))
            color, state = space.write(step, f"color={turn}-{n}", metrics={"moved": F.count(F.when(F.col("moved"), 1))})
            color, changed = color.select("id", "color"), state["moved"]
        tinted = alive.join(color.withColumnRenamed("id", "source"), "source").join(color.select(F.col("id").alias("target"), F.col("color").alias("color2")), "target").filter("color = color2").select("source", "target")
        component = levels(reversed_links(tinted), color.filter("id = color").select(F.col("id").alias("seed")))
        members = component.select("seed", "id")
        real = members.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
        found.append(members.join(real, "seed", "left_semi").select("id"))
        rest = alive.join(members.select(F.col("id").alias("source")), "source", "left_anti").join(members.select(F.col("id").alias("target")), "target", "left_anti")
        alive, seen = space.write(rest.select("source", "target"), f"rest={turn}")
    return reduce(DataFrame.unionByName, found).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(id, pagerank): fixed rounds, containment excluded, parallel edges and self-loops counted, dangling mass spread evenly.

    A round is r' = d M r + c 1, where c brings the sum back to one.  So every r is a sum of the vectors v_j = (d M)^j 1 whose
    factors follow from the sums of the v_j alone.  A round is then one join and one aggregate over what sources give: it
    meets neither all ids nor the ranks before it, and its sum is observed while it is written.  Parallel edges are
    folded into a weight first; shares stay partitioned by source; what is given is summed per target before the shuffle.
    """
    spark = nodes.sparkSession
    space = Workspace(spark, "rank")
    weights = edges.filter("kind <> 'contains'").groupBy("source", "target").agg(F.count(F.lit(1)).alias("w"))
    out = weights.groupBy("source").agg(F.sum("w").alias("out"))
    shares, _ = space.write(weights.join(out, "source").select("source", "target", (F.col("w") / F.col("out") * damping).alias("share")), "shares")
    vector, seen = space.append(nodes.select("id").distinct().withColumn("x", F.lit(1.0)), "vectors", "round", 0)
    n = seen["rows"]
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    shares = shares.repartition(shuffle_width(spark), "source").persist()
    factors, sums = [1.0 / n], []
    for k in range(1, rounds + 1):
        given = shares.join(vector.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("x") * F.col("share")).alias("x"))
        vector, seen = space.append(given, "vectors", "round", k, metrics={"total": F.sum("x")})
        sums.append(seen["total"] or 0.0)
        factors = [(1.0 - sum(a * s for a, s in zip(factors, sums))) / n, *factors]
    shares.unpersist()
    factor = F.element_at(F.array(*[F.lit(a) for a in factors]), F.col("round") + 1)
    return space.whole("vectors", vector, "round").groupBy("id").agg(F.sum(F.col("x") * factor).alias("pagerank"))
