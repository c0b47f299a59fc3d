"""Reference resolution and incremental maintenance over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import resolve as R
from lodegraph.operators.store import Graph
from lodegraph.operators.adjacency import file_dependencies
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


def _nodes(g: Graph) -> DataFrame:
    return g.nodes("kind", "name", "qualified_name", "file_path", "language", "start_line", "start_column", "end_line", "is_exported")


_BUILT = " or ".join(f"(r.language = '{lang}' and r.reference_name in ({', '.join(repr(n) for n in names)}))" for lang, names in R.BUILT_INS.items())
_CALLABLE = ", ".join(f"'{k}'" for k in R.CALLABLE)
_FAMILY = lambda c: "case " + " ".join(f"when {c} = '{k}' then '{v}'" for k, v in R.FAMILIES.items()) + f" else {c} end"
_OPEN = f"""u as (select * from refs r where not coalesce({_BUILT}, false) or exists (select 1 from n where n.kind in ({_CALLABLE}) and n.name = r.reference_name and n.language = r.language)),
  k as (select * from u where reference_name in (select name from n) or regexp_extract(reference_name, '([^./:]+)$', 1) in (select name from n) or regexp_extract(reference_name, '^([^./:]+)', 1) in (select name from n))"""
_NEAR = """(case when regexp_replace(a, '/?[^/]*$', '') = '' or regexp_replace(b, '/?[^/]*$', '') = '' then 0 else least(80, 15 * (select count(*) from range(1, 9) as q(i) where
   q.i <= least(len(string_split(regexp_replace(a, '/?[^/]*$', ''), '/')), len(string_split(regexp_replace(b, '/?[^/]*$', ''), '/')))
   and list_slice(string_split(regexp_replace(a, '/?[^/]*$', ''), '/'), 1, q.i) = list_slice(string_split(regexp_replace(b, '/?[^/]*$', ''), '/'), 1, q.i))) end)"""


@query(with_(N, _OPEN) + "select ref_id, reference_name from u")
def r1_builtin_filter(g: Graph) -> DataFrame:
    return R.unfiltered(g.raw("refs"), _nodes(g)).select("ref_id", "reference_name")


@query(with_(N, _OPEN) + "select ref_id from k")
def r2_prefilter(g: Graph) -> DataFrame:
    nodes = _nodes(g)
    return R.known(R.unfiltered(g.raw("refs"), nodes), nodes).select("ref_id")


_EXACT = f"""sym as (select * from n where kind not in ('file', 'import')), sz as (select name, count(*) as c from sym group by 1),
  pr as (select r.ref_id, n.id as target, sz.c, n.file_path as b, n.start_line, n.start_column, r.language = n.language as same_lang, r.file_path as a,
     r.file_path = n.file_path as same_file, case when r.reference_kind = 'calls' and n.kind in ('function', 'method') then 25 when r.reference_kind = 'instantiates' and n.kind in ('class', 'struct', 'interface') then 25 else 0 end
       + case when n.is_exported = 1 then 10 else 0 end + case when r.file_path = n.file_path and r.line <> 0 then greatest(0.0, 20 - abs(n.start_line - r.line) / 10) else 0 end as rest
     from refs r join sym n on n.name = r.reference_name join sz on sz.name = r.reference_name where sz.c <= {R.CEILING}),
  sc as (select *, {_NEAR} as near from pr), sd as (select *, coalesce(case when same_file then 100 else 0 end + near + case when same_lang then 50 else -80 end + rest, -100.0) as score from sc)"""


@query(with_(N, _EXACT) + """select ref_id, target, confidence, 'exact-match' as resolved_by from (select ref_id, target, cast(case when c = 1 then case when same_lang then 0.9 else 0.5 end when near >= 30 then 0.7 else 0.4 end as double) as confidence,
   row_number() over (partition by ref_id order by score desc, b, start_line, start_column, target) as rk from sd where c = 1 or score > -1) where rk = 1""")
def r10_exact_scored(g: Graph) -> DataFrame:
    return R.by_exact_name(g.raw("refs"), _nodes(g))


@query(with_(N) + f"""select r.ref_id, any_value(n.id) as target, cast(case when any_value(r.language) = any_value(n.language) then 0.5 else 0.3 end as double) as confidence, 'fuzzy' as resolved_by
   from refs r join n on lower(n.name) = lower(r.reference_name) and n.kind in ({_CALLABLE}) group by r.ref_id having count(*) = 1""")
def r11_fuzzy_unique(g: Graph) -> DataFrame:
    return R.by_unique_fuzzy_name(g.raw("refs"), _nodes(g))


@query(with_(N, "fn as (select *, count(*) over (partition by name) as c from n where kind in ('function', 'method'))") + f"""select ref_id, target, confidence, 'function-ref' as resolved_by from (select *, row_number() over (partition by ref_id order by confidence desc, b, start_line, start_column, target) as rk from (
   select r.ref_id, n.id as target, n.file_path as b, n.start_line, n.start_column, cast(case when r.file_path = n.file_path then 0.95 when n.c = 1 then 0.8 end as double) as confidence
   from refs r join fn n on n.name = r.reference_name where r.reference_kind = 'function_ref' and n.c <= {R.CEILING} and {_FAMILY('r.language')} = {_FAMILY('n.language')} and n.id <> r.from_node_id) where confidence is not null) where rk = 1""")
def r12_function_ref(g: Graph) -> DataFrame:
    return R.by_function_reference(g.raw("refs"), _nodes(g))


@query(with_(N, L, DEPS, "q as (select path || '>' || depends_on as ref_id, regexp_extract(depends_on, '([^/]+/[^/]+)$', 1) as nm, path as a from deps where depends_on like '%/%')", "fl as (select *, regexp_extract(file_path, '([^/]+)$', 1) as base, count(*) over (partition by regexp_extract(file_path, '([^/]+)$', 1)) as c from n where kind = 'file')") + f"""
   select ref_id, target, confidence from (select *, row_number() over (partition by ref_id order by confidence * 1000 + {_NEAR} desc, b, start_line, start_column, target) as rk from (
   select q.ref_id, fl.id as target, q.a, fl.file_path as b, fl.start_line, fl.start_column, cast(case when fl.file_path = q.nm then 0.95 when ends_with(fl.file_path, '/' || q.nm) then 0.85 when fl.c = 1 then 0.7 end as double) as confidence
   from q join fl on fl.base = regexp_extract(q.nm, '([^/]+)$', 1) where fl.c <= {R.CEILING}) where confidence is not null) where rk = 1""")
def r3_file_path(g: Graph) -> DataFrame:
    """Files that others depend on, named by folder and base name: whole path, path end, or a lone base name, the nearest first."""
    nodes = _nodes(g)
    short = F.regexp_extract("depends_on", "([^/]+/[^/]+)$", 1)
    deps = file_dependencies(g.links(), g.nodes("file_path")).filter("depends_on like '%/%'")
    refs = deps.select(F.concat_ws(">", "path", "depends_on").alias("ref_id"), short.alias("reference_name"), F.lit("imports").alias("reference_kind"), F.col("path").alias("file_path"), F.lit("").alias("language"), F.lit(1).alias("line"), F.col("path").alias("from_node_id"))
    return R.by_file_path(refs, nodes).select("ref_id", "target", "confidence")


@query(with_(N, L, "q as (select distinct s.file_path || '>' || t.qualified_name as ref_id, t.qualified_name as reference_name, s.file_path from l join n s on s.id = l.source join n t on t.id = l.target where l.kind in ('calls', 'references') and t.qualified_name is not null and s.file_path is not null)") + """select ref_id, target, confidence from (select *, row_number() over (partition by ref_id order by confidence * 1000 + same desc, b, start_line, start_column, target) as rk from (
   select q.ref_id, n.id as target, cast(case when n.qualified_name = q.reference_name then 0.95 else 0.85 end as double) as confidence, case when q.file_path = n.file_path then 100 else 0 end as same, n.file_path as b, n.start_line, n.start_column
   from q join (select *, count(*) over (partition by regexp_extract(qualified_name, '([^./:]+)$', 1)) as c from n) n on regexp_extract(n.qualified_name, '([^./:]+)$', 1) = regexp_extract(q.reference_name, '([^./:]+)$', 1)
   where n.c <= 500 and ends_with(n.qualified_name, q.reference_name) and regexp_matches(q.reference_name, '::|\\.|/'))) where rk = 1""")
def r4_qualified(g: Graph) -> DataFrame:
    """Symbols that files call or refer to, named in full, and what the names find."""
    nodes = _nodes(g)
    ends = nodes.select(F.col("id").alias("target"), F.col("qualified_name").alias("reference_name")).filter("reference_name is not null")
    used = g.links("calls", "references").join(ends, "target").join(nodes.select(F.col("id").alias("source"), "file_path", "language"), "source").filter("file_path is not null").select("file_path", "reference_name").distinct()
    refs = used.select(F.concat_ws(">", "file_path", "reference_name").alias("ref_id"), "reference_name", F.lit("calls").alias("reference_kind"), "file_path", F.lit("").alias("language"), F.lit(1).alias("line"), F.lit("").alias("from_node_id"))
    return R.by_qualified_name(refs, nodes).select("ref_id", "target", "confidence")


# No reference of the tables holds a separator, so the strategies for paths and qualified names (r3, r4) answer nothing here.
_FN = "fn as (select *, count(*) over (partition by name) as c from n where kind in ('function', 'method'))"
_ANSWERS = f"""answers as (
   select ref_id, target, confidence, 'function-ref' as resolved_by, 0 as turn from (select *, row_number() over (partition by ref_id order by confidence desc, b, start_line, start_column, target) as rk from (
     select r.ref_id, n.id as target, n.file_path as b, n.start_line, n.start_column, cast(case when r.file_path = n.file_path then 0.95 when n.c = 1 then 0.8 end as double) as confidence
     from k r join fn n on n.name = r.reference_name where r.reference_kind = 'function_ref' and n.c <= {R.CEILING} and {_FAMILY('r.language')} = {_FAMILY('n.language')} and n.id <> r.from_node_id) where confidence is not null) where rk = 1
   union all select ref_id, target, cast(case when c = 1 then case when same_lang then 0.9 else 0.5 end when near >= 30 then 0.7 else 0.4 end as double), 'exact-match', 3 from (
     select *, row_number() over (partition by ref_id order by score desc, b, start_line, start_column, target) as rk from sd where c = 1 or score > -1) where rk = 1
   union all select r.ref_id, any_value(n.id), cast(case when any_value(r.language) = any_value(n.language) then 0.5 else 0.3 end as double), 'fuzzy', 4 from k r join n on lower(n.name) = lower(r.reference_name) and n.kind in ({_CALLABLE}) group by r.ref_id having count(*) = 1)"""
_BEST = "best as (select ref_id, target, confidence, resolved_by from (select *, row_number() over (partition by ref_id order by case when confidence >= 0.9 then 0 else 1 end, confidence desc, turn, target) as rk from answers) where rk = 1)"
_CASCADE = with_(N, _OPEN, _EXACT.replace("from refs r join sym", "from k r join sym"), _FN, _ANSWERS, _BEST)


@query(_CASCADE + "select ref_id, target, confidence, resolved_by from best")
def r18_resolve_all(g: Graph) -> DataFrame:
    """The cascade over plain names: function reference, file path, qualified, exact and fuzzy name; imports, receivers and chains need more than the name (r13 to r16, r5, r7, r20)."""
    return R.resolve(g.raw("refs"), _nodes(g))


@query(_CASCADE + f"""select ref_id, source, target, kind, line, col, confidence, resolved_by from (select b.ref_id, r.from_node_id as source, b.target, r.line, r.col, b.confidence, b.resolved_by,
   case when r.reference_kind = 'extends' and n.kind in ('interface', 'protocol') then 'implements' when r.reference_kind = 'calls' and n.kind in ('class', 'struct', 'union') then 'instantiates' when r.reference_kind = 'function_ref' then 'references' else r.reference_kind end as kind,
   r.reference_kind <> 'references' or {_FAMILY('r.language')} = {_FAMILY('n.language')} as passes from best b join refs r using (ref_id) join n on n.id = b.target) where passes""")
def r19_resolved_edges(g: Graph) -> DataFrame:
    nodes = _nodes(g)
    return R.resolved_edges(g.raw("refs"), nodes, R.resolve(g.raw("refs"), nodes))


@query(_CASCADE + "select ref_id, reference_name, reference_kind from refs where ref_id not in (select ref_id from best)")
def r21_unresolved_leftover(g: Graph) -> DataFrame:
    """References that stay unresolved."""
    refs = g.raw("refs")
    return refs.join(R.resolve(refs, _nodes(g)).select("ref_id"), "ref_id", "left_anti").select("ref_id", "reference_name", "reference_kind")


@query(with_(N, E) + f"select e.id, s.language as source_language, t.language as target_language from e join n s on s.id = e.source join n t on t.id = e.target where e.kind = 'references' and {_FAMILY('s.language')} <> {_FAMILY('t.language')}")
def r17_gates(g: Graph) -> DataFrame:
    """References that cross language families: what the gate refuses."""
    lang = g.nodes("language")
    met = g.edges().filter("kind = 'references'").join(lang.select(F.col("id").alias("source"), F.col("language").alias("source_language")), "source").join(lang.select(F.col("id").alias("target"), F.col("language").alias("target_language")), "target")
    return met.filter(R.family(F.col("source_language")) != R.family(F.col("target_language"))).select("id", "source_language", "target_language")


# --- incremental maintenance


@query(with_(FILES, "s as (select path, arg_max(lower(content_hash), row(observed_at, scan_id)) as h, arg_max(size, row(observed_at, scan_id)) as z, arg_max(modified_at, row(observed_at, scan_id)) as m from scans where path is not null and content_hash is not null group by path)") + """
  select coalesce(f.path, s.path) as path, case when f.path is null then 'added' when s.path is null then 'unseen' when s.z = f.size and s.m = f.modified_at then 'skipped' when s.h = lower(f.content_hash) then 'same' else 'changed' end as status from f full join s on s.path = f.path""")
def t3_change_status(g: Graph) -> DataFrame:
    """Index against the last scan: size and time first, then the hash."""
    last = g.raw("scans").filter("path is not null and content_hash is not null").groupBy("path").agg(F.max_by(F.struct(F.lower("content_hash").alias("h"), F.col("size").alias("z"), F.col("modified_at").alias("m")), F.struct("observed_at", "scan_id")).alias("s"), F.lit(True).alias("scanned"))
    met = g.files().select("path", F.lower("content_hash").alias("h"), F.col("size").alias("z"), F.col("modified_at").alias("m"), F.lit(True).alias("indexed")).join(last, "path", "full_outer")
    status = F.when(F.col("indexed").isNull(), "added").when(F.col("scanned").isNull(), "unseen").when((F.col("s.z") == F.col("z")) & (F.col("s.m") == F.col("m")), "skipped").when(F.col("s.h") == F.col("h"), "same").otherwise("changed")
    return met.select("path", status.alias("status"))


SQL["t10_outcome"] = f"select status, count(*) as n_files from ({SQL['t3_change_status']}) group by status"


@query(SQL["t10_outcome"])
def t10_outcome(g: Graph) -> DataFrame:
    return t3_change_status(g).groupBy("status").agg(count().alias("n_files"))


@query("""select path, min(modified_at) as first_seen, max(modified_at) as last_seen, count(*) as n_events from (
   select *, sum(fresh) over (partition by path order by modified_at, scan_id) as burst from (
     select path, scan_id, modified_at, case when modified_at - lag(modified_at) over (partition by path order by modified_at, scan_id) < 2000 then 0 else 1 end as fresh from scans where path is not null and modified_at is not null)) group by path, burst""")
def t1_debounce_sessions(g: Graph) -> DataFrame:
    """Bursts of changes per file: an event within two seconds of the one before prolongs the burst."""
    rows = g.raw("scans").filter("path is not null and modified_at is not null").select("path", "modified_at", F.timestamp_millis("modified_at").alias("at"))
    return rows.groupBy("path", F.session_window("at", "2 seconds")).agg(F.min("modified_at").alias("first_seen"), F.max("modified_at").alias("last_seen"), count().alias("n_events")).select("path", "first_seen", "last_seen", "n_events")


_SCOPE = with_(N, L, FILES, "changed as (select distinct n.id, n.name, n.file_path from n join f on f.path = n.file_path where f.modified_at >= (select max(modified_at) from f) - 86400000)")


@query(_SCOPE + """select distinct ref_id from refs where file_path in (select file_path from changed) or reference_name in (select name from changed)
   or from_node_id in (select source from l where kind <> 'contains' and target in (select id from changed))""")
def t6_site_scope(g: Graph) -> DataFrame:
    """References to resolve again after a day's changes: of changed files, of changed names, at sites that pointed to changed symbols."""
    files = g.files()
    last = files.agg(F.max("modified_at").alias("last"))
    fresh = files.filter(F.col("modified_at") >= last.scalar() - 86_400_000).select(F.col("path").alias("file_path"))
    changed = g.nodes("name", "file_path").join(fresh, "file_path", "left_semi")
    refs = g.raw("refs").select("ref_id", "file_path", "reference_name", "from_node_id")
    a = refs.join(changed.select("file_path").distinct(), "file_path", "left_semi")
    b = refs.join(changed.select(F.col("name").alias("reference_name")).distinct(), "reference_name", "left_semi")
    hit = g.links().filter("kind <> 'contains'").join(changed.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("from_node_id")).distinct()
    c = refs.join(hit, "from_node_id", "left_semi")
    return a.select("ref_id").unionByName(b.select("ref_id")).unionByName(c.select("ref_id")).distinct()


@query("select path, count(distinct lower(content_hash)) as n_stale from (select s.path, s.content_hash from scans s join file_texts t on t.path = s.path where s.content_hash is not null and lower(s.content_hash) <> sha256(t.text)) group by 1")
def m15_stale_files(g: Graph) -> DataFrame:
    """Files of which scans saw other contents than the text at hand, and how many."""
    texts = g.raw("file_texts").select("path", F.sha2("text", 256).alias("now"))
    seen = g.raw("scans").filter("path is not null and content_hash is not null").select("path", F.lower("content_hash").alias("h")).distinct()
    return seen.join(texts, "path").filter("h <> now").groupBy("path").agg(count().alias("n_stale"))
