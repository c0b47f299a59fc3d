"""Hierarchies (p2), incremental processing (p3) and skewed keys (p6) over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.hierarchy import descendants, hierarchies, loop_members, project_links
from lodegraph.operators.incremental import project_replay
from lodegraph.operators.skew import heavy_pairs, pair_profile
from lodegraph.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchies(project_links(spark, folder), with_paths=False)


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchies(project_links(spark, folder))
    return tree.select("kind", "node_id", "root_id", "depth", F.array_join("path", ">").alias("path"))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(hierarchies(project_links(spark, folder)))


def p2_loops(spark: SparkSession, folder: str) -> DataFrame:
    links = project_links(spark, folder)
    return loop_members(links, hierarchies(links, with_paths=False))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return project_replay(spark, folder).select("run_id", "path")


def p3_cases(spark: SparkSession, folder: str) -> DataFrame:
    return project_replay(spark, folder).groupBy("run_id", "case").agg(F.count(F.lit(1)).alias("n_paths"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_pairs(table(spark, folder, "edges"), table(spark, folder, "nodes"))


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pair_profile(table(spark, folder, "edges"), table(spark, folder, "nodes"))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_loops, p3_found, p3_cases, p6_found, p6_pairs)}

_LINKS = """
known as (select distinct id from nodes where id is not null),
links as (
  select distinct kind, case when kind = 'contains' then source else target end as parent,
         case when kind = 'contains' then target else source end as child
  from edges where kind in ('contains', 'extends') and source in (select id from known) and target in (select id from known)),
everyone as (select kind, parent as node_id from links union select kind, child from links),
tree(kind, node_id, root_id, depth, path) as (
  select distinct l.kind, l.parent, l.parent, 0, l.parent from links l
  where not exists (select 1 from links m where m.kind = l.kind and m.child = l.parent)
  union all
  select l.kind, l.child, t.root_id, t.depth + 1, t.path || '>' || l.child from tree t join links l on l.kind = t.kind and l.parent = t.node_id)
"""

_LOST = "from everyone e where not exists (select 1 from tree t where t.kind = e.kind and t.node_id = e.node_id)"

_REPLAY = """
ok as (select run_id, coalesce(lag(run_id) over (order by run_id), -1) as before from runs where status = 'ok'),
due as (
  select o.run_id, s.path, arg_max(lower(s.content_hash), row(s.observed_at, s.scan_id)) as h, max(s.observed_at) as t
  from scans s join ok o on s.run_id > o.before and s.run_id <= o.run_id
  where s.content_hash is not null and s.path is not null and s.observed_at is not null group by 1, 2),
known as (select path, lower(arg_max(content_hash, indexed_at)) as h, max(indexed_at) as t from files where path is not null group by 1),
-- a row counts if it is later than everything before it on its path
events as (select path, 0 as run_id, h, t from known union all select path, run_id, h, t from due),
running as (select *, max(t) over (partition by path order by run_id rows between unbounded preceding and 1 preceding) as best from events),
counted as (select * from running where best is null or t > best),
cases as (select *, lag(h) over (partition by path order by run_id) as prev from counted)
"""

SQL = {
    "p2_found": f"with recursive {_LINKS} select kind, node_id, root_id, depth from tree union all select e.kind, e.node_id, '', -1 {_LOST}",
    "p2_paths": f"with recursive {_LINKS} select kind, node_id, root_id, depth, path from tree union all select e.kind, e.node_id, '', -1, null {_LOST}",
    "p2_descendants": f"""with recursive {_LINKS},
        up(kind, ancestor_id, node_id, distance) as (
          select l.kind, l.parent, l.child, 1 from links l join tree t on t.kind = l.kind and t.node_id = l.child
          union all
          select u.kind, l.parent, u.node_id, u.distance + 1 from up u join links l on l.kind = u.kind and l.child = u.ancestor_id)
        select kind, ancestor_id, node_id, distance from up""",
    "p2_loops": f"""with recursive {_LINKS},
        reach(kind, start_id, at_id) as (
          select l.kind, l.child, l.parent from links l where exists (select 1 {_LOST.replace('where', 'where e.kind = l.kind and e.node_id = l.child and')})
          union
          select r.kind, r.start_id, l.parent from reach r join links l on l.kind = r.kind and l.child = r.at_id)
        select kind, start_id as node_id from reach where start_id = at_id""",
    "p3_found": f"with {_REPLAY} select run_id, path from cases where run_id > 0 and (prev is null or prev <> h)",
    "p3_cases": f"""with {_REPLAY} select run_id, case when prev is null then 'new' else 'changed' end as "case", count(*) as n_paths
        from cases where run_id > 0 and (prev is null or prev <> h) group by 1, 2""",
    "p6_found": "select target, kind from edges group by target, kind having count(*) >= 0.01 * (select count(*) from edges)",
    "p6_pairs": """select e.target, e.kind, count(*) as n_rows, count(distinct e.source) as n_sources,
        coalesce(any_value(s.n), 0) as n_sightings, count(*) * coalesce(any_value(s.n), 0) as n_joined
        from edges e left join (select id, count(*) as n from nodes group by id) s on s.id = e.target group by e.target, e.kind""",
}
