"""Graph questions: one step, traversal, impact, hierarchy of types, cycles, centrality, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.paths import TEST_FILE, glob_regex, is_test_file
from lodegraph.operators.adjacency import CONTAINERS, callees, callers, file_dependencies, strongest
from lodegraph.operators.hierarchy import hierarchies, project_links
from lodegraph.operators.store import Graph
from lodegraph.operators.traversal import bfs, cyclic, impact, levels, pagerank, reversed_links, shortest_paths
from lodegraph.plans.settings import text
from lodegraph.queries.sql import DEPS, E, L, N, with_
from lodegraph.queries.sql import F as FILES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Graph(spark, folder))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def count():
    return F.count(F.lit(1))


_CONTAINERS = ", ".join(f"'{k}'" for k in CONTAINERS)
#: Every symbol, or every class, as a seed.
_ALL = "seeds as (select id as seed from n)"
_CLASSES = "seeds as (select id as seed from n where kind = 'class')"


def symbols(g: Graph) -> DataFrame:
    return g.nodes("kind").select(F.col("id").alias("seed"))


def classes(g: Graph) -> DataFrame:
    return g.nodes("kind").filter("kind = 'class'").select(F.col("id").alias("seed"))


# --- one step


@query(with_(L) + "select distinct target as node_id, source as caller_id, kind from l where kind in ('calls', 'references', 'imports')")
def h3_callers(g: Graph) -> DataFrame:
    return callers(g.links())


@query(with_(L) + "select distinct source as node_id, target as callee_id, kind from l where kind in ('calls', 'references', 'imports')")
def h4_callees(g: Graph) -> DataFrame:
    return callees(g.links())


_CALL = "c as (select distinct source, target from l where kind in ('calls', 'references', 'imports'))"


@query(with_(N, L, _ALL, _CALL) + """select seed, id, min(depth) as depth from (
  select seed, seed as id, 0 as depth from seeds union all select seed, c.source, 1 from seeds join c on c.target = seed
  union all select seed, d.source, 2 from seeds join c on c.target = seed join c d on d.target = c.source) group by 1, 2""")
def h3_callers_depth2(g: Graph) -> DataFrame:
    """Callers of every symbol over two steps."""
    return levels(reversed_links(g.links("calls", "references", "imports")), symbols(g), 2).select("seed", "id", "depth")


@query(with_(N, L, _ALL, _CALL) + "select distinct seed, role, id from (select seed, 'caller' as role, c.source as id from seeds join c on c.target = seed union all select seed, 'callee', c.target from seeds join c on c.source = seed union all select seed, 'focal', seed from seeds)")
def h5_call_graph(g: Graph) -> DataFrame:
    """Callers and callees of every symbol: each is focal, and each call is seen from both ends."""
    pairs = g.links("calls", "references", "imports").select("source", "target").distinct()
    back = pairs.select(F.col("target").alias("seed"), F.lit("caller").alias("role"), F.col("source").alias("id"))
    ahead = pairs.select(F.col("source").alias("seed"), F.lit("callee").alias("role"), F.col("target").alias("id"))
    return back.unionByName(ahead).unionByName(symbols(g).select("seed", F.lit("focal").alias("role"), F.col("seed").alias("id")))


@query(with_(E) + "select target as node_id, kind, count(*) as n_usages from e group by 1, 2")
def h7_usages(g: Graph) -> DataFrame:
    return g.edges().groupBy(F.col("target").alias("node_id"), "kind").agg(count().alias("n_usages"))


@query(with_(N, L) + "select l.source as node_id, l.target as child_id, n.kind as child_kind from l join n on n.id = l.target where l.kind = 'contains'")
def h11_children(g: Graph) -> DataFrame:
    return g.links("contains").join(g.nodes("kind").select(F.col("id").alias("target"), F.col("kind").alias("child_kind")), "target").select(F.col("source").alias("node_id"), F.col("target").alias("child_id"), "child_kind")


@query(with_(N) + "select name, count(*) as n_definitions, count(distinct file_path) as n_files from n where kind in ('function', 'method', 'class') group by name")
def h13_definitions(g: Graph) -> DataFrame:
    rows = g.nodes("kind", "name", "file_path").filter(F.col("kind").isin("function", "method", "class"))
    fine = rows.groupBy("name", "file_path").agg(count().alias("n"))
    return fine.groupBy("name").agg(F.sum("n").alias("n_definitions"), F.count("file_path").alias("n_files"))


# --- traversal


def _reach(pairs: str, seeds: str, *ctes: str, depth: int | None = None) -> str:
    """Shortest depths from seeds; UNION keeps (seed, id, depth) once, the depth bound or the number of levels ends it."""
    bound = f"and r.depth < {depth}" if depth is not None else ""
    return with_(*ctes, seeds, pairs, f"r(seed, id, depth) as (select seed, seed, 0 from seeds union select r.seed, p.target, r.depth + 1 from r join p on p.source = r.id where true {bound})", recursive=True) + "select seed, id, min(depth) as depth from r group by 1, 2"


@query(_reach("p as (select distinct source, target from l)", _CLASSES, N, L, depth=3))
def h1_bfs_depth(g: Graph) -> DataFrame:
    """Everything within three outgoing edges of every class."""
    return levels(g.links(), classes(g), 3).select("seed", "id", "depth")


_BOTH = """p as (select source, target, case kind when 'contains' then 0 when 'calls' then 1 else 2 end as priority from l where kind in ('contains', 'calls', 'extends')
    union select target, source, case kind when 'contains' then 0 when 'calls' then 1 else 2 end from l where kind in ('contains', 'calls', 'extends')),
  q as (select p.* from p join n on n.id = p.target and n.kind <> 'file'),
  d1 as (select seed, q.target as id, min(priority) as priority from seeds join q on q.source = seed where q.target <> seed group by 1, 2),
  d2 as (select d1.seed, q.target as id, min(q.priority) as priority from d1 join q on q.source = d1.id where q.target <> d1.seed and not exists (select 1 from d1 o where o.seed = d1.seed and o.id = q.target) group by 1, 2)"""


@query(with_(N, L, _CLASSES, _BOTH) + """select seed, id, depth, rk as rank from (select *, row_number() over (partition by seed order by depth, priority, id) as rk from (
  select seed, seed as id, 0 as depth, 0 as priority from seeds union all select seed, id, 1, priority from d1 union all select seed, id, 2, priority from d2)) where rk <= 40""")
def h1_bfs_options(g: Graph) -> DataFrame:
    """Around every class, both ways over containment, calls and inheritance, no files, at most 40 nodes: containment before calls before the rest."""
    return bfs(g.raw("edges"), g.nodes("kind"), classes(g), 2, edge_kinds=["contains", "calls", "extends"], refuse_kinds=["file"], direction="both", limit=40)


@query(with_(L, "p as (select source, target from l where kind in ('extends', 'implements'))", "r(node_id, ancestor_id) as (select source, target from p union select r.node_id, p.target from r join p on p.source = r.ancestor_id)", recursive=True) + "select node_id, ancestor_id from r where node_id <> ancestor_id")
def h6_type_ancestors(g: Graph) -> DataFrame:
    """All supertypes of every type."""
    links = g.links("extends", "implements")
    reach = levels(links, links.select(F.col("source").alias("seed")).distinct())
    return reach.filter("depth > 0").select(F.col("seed").alias("node_id"), F.col("id").alias("ancestor_id"))


_IMPACT = f"""{_CLASSES},
  inside as (select l.source, l.target from l join n on n.id = l.source and n.kind in ({_CONTAINERS}) where l.kind = 'contains'),
  back as (select distinct target as source, source as target from l where kind <> 'contains'),
  r(seed, id, depth) as (select seed, seed, 0 from seeds union
    select r.seed, m.target, r.depth + m.cost from r join (select source, target, 0 as cost from inside union all select source, target, 1 from back) m on m.source = r.id where r.depth + m.cost <= 2)"""


@query(with_(N, L, _IMPACT, recursive=True) + "select seed, id, min(depth) as depth from r group by 1, 2")
def h8_impact(g: Graph) -> DataFrame:
    """What depends, over two levels, on every class or its members."""
    return impact(g.links(), g.nodes("kind"), classes(g), 2)


#: Steps of a path that still says how two symbols are connected.
MAX_PATH = 3
_PATH = f"""pairs as (select distinct from_node_id as from_id, unnest(candidates) as to_id from refs where from_node_id is not null),
  p as (select distinct source, target from l where kind <> 'contains'),
  r(from_id, id, depth) as (select distinct from_id, from_id, 0 from pairs union select r.from_id, p.target, r.depth + 1 from r join p on p.source = r.id where r.depth < {MAX_PATH})"""


@query(with_(L, _PATH, recursive=True) + "select pairs.from_id, pairs.to_id, min(r.depth) as length from r join pairs on pairs.from_id = r.from_id and pairs.to_id = r.id group by 1, 2")
def h9_shortest_path(g: Graph) -> DataFrame:
    """Lengths of the shortest paths, of three steps at most, from the symbol of every open reference to its candidates."""
    refs = g.raw("refs").filter("from_node_id is not null")
    pairs = refs.select(F.col("from_node_id").alias("from_id"), F.explode("candidates").alias("to_id")).filter("to_id is not null").distinct()
    return shortest_paths(g.links().filter("kind <> 'contains'"), pairs, MAX_PATH).select("from_id", "to_id", "length")


@query(with_(N, L, "p as (select source, target from l where kind = 'contains')", "r(node_id, ancestor_id, distance) as (select target, source, 1 from p union select r.node_id, p.source, r.distance + 1 from r join p on p.target = r.ancestor_id where r.distance < 40)", recursive=True) + """select node_id, ancestor_id, distance from r where node_id in (
   select id from (with recursive t(id) as (select distinct source from p where source not in (select target from p) union select p.target from p join t on t.id = p.source) select id from t))""")
def h10_ancestors(g: Graph) -> DataFrame:
    """Containers of every node, nearest at distance 1; nodes on or below a loop have no root and are left to p2."""
    tree = hierarchies(project_links(g.spark, g.folder).filter("kind = 'contains'"))
    steps = tree.filter("depth > 0").select("node_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return steps.filter("at < depth").select("node_id", "ancestor_id", (F.col("depth") - F.col("at")).alias("distance"))


_SPARSE = """p as (select distinct s.file_path as source, t.file_path as target from l join n s on s.id = l.source join n t on t.id = l.target
  where l.kind in ('extends', 'implements', 'overrides', 'decorates') and s.file_path <> t.file_path)"""


def sparse_dependencies(g: Graph) -> DataFrame:
    return file_dependencies(g.links("extends", "implements", "overrides", "decorates"), g.nodes("file_path")).select(F.col("path").alias("source"), F.col("depends_on").alias("target"))


_WHOLE = "p as materialized (select path as source, depends_on as target from deps)"


def whole_dependencies(g: Graph) -> DataFrame:
    """The file graph of all kinds except containment."""
    return file_dependencies(g.links(), g.nodes("file_path")).select(F.col("path").alias("source"), F.col("depends_on").alias("target"))


@query(with_(N, L, DEPS, _WHOLE, "r(a, b) as (select source, target from p union select r.a, p.target from r join p on p.source = r.b)", recursive=True) + "select distinct a as path from r where a = b")
def h12_cyclic_files(g: Graph) -> DataFrame:
    """Files on a cycle of dependencies of any kind: calls, references and imports too."""
    return cyclic(whole_dependencies(g)).select(F.col("id").alias("path"))


def _pagerank_sql(rounds: int = 30) -> str:
    parts = [N, E, "w as (select source, target, count(*) as w from e where kind <> 'contains' group by 1, 2)", "o as (select source, sum(w) as o from w group by 1)", "s as materialized (select w.source, w.target, w.w / o.o as share from w join o using (source))"]
    parts += ["i as materialized (select n.id, o.o is null as dangling, (select count(*) from n) as total from n left join o on o.source = n.id)", "r0 as materialized (select id, 1.0 / total as pr from i)"]
    for k in range(1, rounds + 1):
        parts.append(f"""r{k} as materialized (select i.id, 0.15 / i.total + 0.85 * (select coalesce(sum(r.pr), 0) from r{k - 1} r join i j on j.id = r.id where j.dangling) / i.total + 0.85 * coalesce(g.given, 0) as pr
          from i left join (select s.target, sum(r.pr * s.share) as given from s join r{k - 1} r on r.id = s.source group by 1) g on g.target = i.id)""")
    return with_(*parts) + f"select id, round(pr, 8) as pagerank from r{rounds}"


@query(_pagerank_sql())
def h14_pagerank(g: Graph) -> DataFrame:
    return pagerank(g.nodes("kind"), g.edges()).select("id", F.round("pagerank", 8).alias("pagerank"))


_AFFECTED = f"""changed as (select path from f where modified_at >= (select max(modified_at) from f) - 86400000),
  back as (select target as source, source as target from p),
  r(path) as (select path from changed union select back.target from r join back on back.source = r.path where not regexp_matches(r.path, '{TEST_FILE}'))"""


@query(with_(N, L, FILES, DEPS, _WHOLE, _AFFECTED, recursive=True) + f"select path, regexp_matches(path, '{TEST_FILE}') as is_test from r")
def h15_affected_tests(g: Graph) -> DataFrame:
    """Files affected, over dependencies of any kind, by what changed on the last day; test files are collected and not expanded."""
    return affected(g, whole_dependencies(g))


def affected(g: Graph, dependencies: DataFrame) -> DataFrame:
    """(path, is_test): the files changed on the last day and what depends on them over (source, target) pairs of files."""
    files = g.files()
    last = files.agg(F.max("modified_at").alias("last"))
    changed = files.filter(F.col("modified_at") >= last.scalar() - 86_400_000)
    glob = text(g.spark, "testGlob")
    is_test = F.col("id").rlike(glob_regex(glob)) if glob else is_test_file(F.col("id"))
    reach = levels_from_set(reversed_links(dependencies), changed.select(F.col("path").alias("id")), expand=~is_test)
    return reach.select(F.col("id").alias("path"), is_test.alias("is_test"))


def levels_from_set(links: DataFrame, starts: DataFrame, expand=None) -> DataFrame:
    """(id) reached from any of ``starts``: one common seed, linked to all of them."""
    root = "\x00"
    entry = starts.select(F.lit(root).alias("source"), F.col("id").alias("target"))
    seeds = links.sparkSession.createDataFrame([(root,)], "seed string")
    reach = levels(links.unionByName(entry), seeds, expand=expand)
    return reach.filter(F.col("id") != root).select("id", "depth")


@query(with_(N, L, _ALL) + f"""select seed, count(*) as n_callers, count(*) filter (where regexp_matches(n.file_path, '{TEST_FILE}')) as n_test_callers, count(distinct n.file_path) as n_files
  from (select distinct seed, source from seeds join l on l.target = seed where kind in ('calls', 'references', 'imports')) c join n on n.id = c.source group by seed""")
def h16_blast_radius(g: Graph) -> DataFrame:
    """Direct callers of every symbol that has some, in tests and elsewhere."""
    return blast_radius(g, g.links("calls", "references", "imports"))


def blast_radius(g: Graph, links: DataFrame) -> DataFrame:
    """Callers, callers in tests and files with callers of every target of ``links``."""
    near = links.select(F.col("target").alias("seed"), F.col("source").alias("id")).distinct()
    met = near.join(g.nodes("file_path"), "id").withColumn("is_test", is_test_file(F.col("file_path")))
    fine = met.groupBy("seed", "file_path").agg(count().alias("n"), F.count(F.when(F.col("is_test"), 1)).alias("t"))
    return fine.groupBy("seed").agg(F.sum("n").alias("n_callers"), F.sum("t").alias("n_test_callers"), F.count("file_path").alias("n_files"))


@query(with_(N, L, "m as (select l.source as type_id, n.name from l join n on n.id = l.target and n.kind = 'method' where l.kind = 'contains')", "p as (select source, target from l where kind in ('extends', 'implements'))",
             "r(type_id, at_id, depth) as (select source, target, 1 from p union select r.type_id, p.target, r.depth + 1 from r join p on p.source = r.at_id where r.depth < 5)", recursive=True)
       + "select r.type_id, m.name, min(r.depth) as depth from r join m on m.type_id = r.at_id where r.type_id <> r.at_id and not exists (select 1 from m o where o.type_id = r.type_id and o.name = m.name) group by 1, 2")
def h18_inherited_member(g: Graph) -> DataFrame:
    """Methods that a type gets from a supertype, with the least number of levels up (five at most)."""
    links = g.links("extends", "implements", "contains")
    methods = g.nodes("kind", "name").filter("kind = 'method'").select(F.col("id").alias("target"), "name")
    members = links.filter("kind = 'contains'").join(methods, "target").select(F.col("source").alias("id"), "name").distinct()
    up = links.filter("kind <> 'contains'")
    reach = levels(up, up.select(F.col("source").alias("seed")).distinct(), 5).filter("depth > 0")
    found = reach.join(members, "id").groupBy(F.col("seed").alias("type_id"), "name").agg(F.min("depth").alias("depth"))
    return found.join(members.withColumnRenamed("id", "type_id"), ["type_id", "name"], "left_anti").select("type_id", "name", "depth")


@query(with_(N, L) + "select distinct s.name, s.language, t.name as supertype from l join n s on s.id = l.source join n t on t.id = l.target where l.kind in ('extends', 'implements') and s.name is not null")
def h19_supertypes_by_name(g: Graph) -> DataFrame:
    nodes = g.nodes("name", "language")
    met = g.links("extends", "implements").join(nodes.withColumnRenamed("id", "source"), "source").filter("name is not null")
    return met.join(nodes.select(F.col("id").alias("target"), F.col("name").alias("supertype")), "target").select("name", "language", "supertype").distinct()


@query(with_(N, L, DEPS) + """select file_path as path from n where kind not in ('file', 'import') group by file_path
  having count(*) filter (where kind not in ('class', 'interface', 'struct', 'enum', 'trait', 'type_alias', 'property', 'field')) = 0
  and file_path not in (select depends_on from deps) and file_path not in (select s.file_path from l join n s on s.id = l.source where l.kind in ('calls', 'instantiates'))""")
def h21_ambient_files(g: Graph) -> DataFrame:
    """Files that only declare types, call nothing, and that nothing depends on."""
    nodes = g.nodes("kind", "file_path")
    links = g.links()
    types = F.col("kind").isin("class", "interface", "struct", "enum", "trait", "type_alias", "property", "field")
    only = nodes.filter(~F.col("kind").isin("file", "import")).groupBy(F.col("file_path").alias("path")).agg(F.count(F.when(~types, 1)).alias("others")).filter("others = 0")
    used = file_dependencies(links, nodes).select(F.col("depends_on").alias("path")).distinct()
    busy = links.filter(F.col("kind").isin("calls", "instantiates")).select(F.col("source").alias("id")).distinct().join(nodes, "id").select(F.col("file_path").alias("path")).distinct()
    return only.select("path").join(used, "path", "left_anti").join(busy, "path", "left_anti")


@query(with_(N, L, _ALL) + """select seed, file_path, tier, n_symbols, rk as rank from (select *, row_number() over (partition by seed order by tier desc, n_symbols desc, file_path) as rk from (
  select seed, n.file_path, max(tier) as tier, count(distinct n.id) as n_symbols from (
    select seed, seed as id, 3 as tier from seeds union all select seed, source, 2 from seeds join l on l.target = seed and l.kind in ('calls', 'references', 'imports')
    union all select seed, target, 1 from seeds join l on l.source = seed and l.kind in ('calls', 'references', 'imports', 'contains')) c join n on n.id = c.id group by 1, 2)) where rk <= 10""")
def m5_explore_files(g: Graph) -> DataFrame:
    """Files to read around every symbol: the symbol's own, then callers', then callees' and members'."""
    return explore_files(g, symbols(g))


def explore_files(g: Graph, seeds: DataFrame) -> DataFrame:
    links = g.links()
    call = F.col("kind").isin("calls", "references", "imports")
    back = links.filter(call).join(seeds.withColumnRenamed("seed", "target"), "target", "left_semi").select(F.col("target").alias("seed"), F.col("source").alias("id"), F.lit(2).alias("tier"))
    ahead = links.filter(call | (F.col("kind") == "contains")).join(seeds.withColumnRenamed("seed", "source"), "source", "left_semi").select(F.col("source").alias("seed"), F.col("target").alias("id"), F.lit(1).alias("tier"))
    context = seeds.select("seed", F.col("seed").alias("id"), F.lit(3).alias("tier")).unionByName(back).unionByName(ahead).groupBy("seed", "id").agg(F.max("tier").alias("tier"))
    files = context.join(g.nodes("file_path"), "id").groupBy("seed", "file_path").agg(F.max("tier").alias("tier"), count().alias("n_symbols"))
    return strongest(files, ["seed"], [F.desc("tier"), F.desc("n_symbols"), "file_path"], 10).select("seed", "file_path", "tier", "n_symbols", "rank")


@query(with_(N, L) + f"select l.source as container_id, n.id as member_id, n.name, n.kind, n.start_line, n.start_column from l join n on n.id = l.target join n c on c.id = l.source and c.kind in ({_CONTAINERS}) where l.kind = 'contains'")
def m4_outline(g: Graph) -> DataFrame:
    """Members of every container with their places: one row each, so that no container is gathered into one value."""
    nodes = g.nodes("kind", "name", "start_line", "start_column")
    inside = nodes.filter(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("source"))
    met = g.links("contains").select("source", "target").join(inside, "source", "left_semi").join(nodes.withColumnRenamed("id", "target"), "target")
    return met.select(F.col("source").alias("container_id"), F.col("target").alias("member_id"), "name", "kind", "start_line", "start_column")


@query(_reach("p as (select distinct source, target from l where kind in ('extends', 'implements', 'overrides', 'decorates'))", "seeds as (select distinct source as seed from l where kind = 'extends')", L, depth=60).replace("select seed, id, min(depth) as depth", "select distinct seed, id").replace("group by 1, 2", ""))
def h2_reachable(g: Graph) -> DataFrame:
    """What a depth-first walk without bounds visits from every type that extends another: a set, whatever the order."""
    links = g.links("extends", "implements", "overrides", "decorates")
    seeds = links.filter("kind = 'extends'").select(F.col("source").alias("seed")).distinct()
    return levels(links, seeds).select("seed", "id")
