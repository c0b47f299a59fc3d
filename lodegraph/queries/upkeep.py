"""Upkeep, context and text questions: incremental rebuilds, audits, explore context, statistics, renderings, source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions.paths import basename, directories
from lodegraph.operators import context as C
from lodegraph.operators import search as S
from lodegraph.operators import source_text as X
from lodegraph.operators import sync as Y
from lodegraph.operators.members import methods_of_types
from lodegraph.operators.store import Graph
from lodegraph.queries.resolution import _nodes
from lodegraph.queries.search import SQL as SEARCH_SQL
from lodegraph.queries.search import TEXT
from lodegraph.queries.sql import E, L, N, with_
from lodegraph.queries.sql import F as FILES
from lodegraph.queries.tables import d7_orphan_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def count():
    return F.count(F.lit(1))


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


# --- incremental rebuild


def _before(g: Graph) -> DataFrame:
    """The project one day earlier, made up: files changed on the last day had other function names, generated files did not exist, and each changed file had a twin that is gone."""
    files = g.files()
    last = files.agg(F.max("modified_at").alias("last"))
    state = files.select("path", (F.col("modified_at") >= last.scalar() - 86_400_000).alias("fresh"), F.coalesce(F.col("generated") == 1, F.lit(False)).alias("made"))
    texts = g.raw("file_texts").join(state, "path", "left").select("path", "text", F.coalesce("fresh", F.lit(False)).alias("fresh"), F.coalesce("made", F.lit(False)).alias("made"))
    older = F.when(F.col("fresh"), F.regexp_replace("text", r"\b(load|merge|flush|scan)", "old_$1")).otherwise(F.col("text"))
    kept = texts.filter(~F.col("made") | F.col("fresh")).select("path", older.alias("text"))
    return kept.unionByName(texts.filter("fresh").select(F.concat(F.lit("gone/"), "path").alias("path"), "text"))


@query()
def t11_incremental_equals_full(g: Graph) -> DataFrame:
    """After a day's edits: rows of the index brought up to date that differ from a rebuild (none), beside all rows and what was touched."""
    texts = g.raw("file_texts").select("path", "text")
    synced, touched = Y.sync(Y.build(_before(g)), texts)
    out = Y.differing(synced, Y.build(texts))
    for k, v in touched.items():
        out = out.withColumn(f"n_touched_{k}", F.lit(v).cast("bigint"))
    return out


_HEAVY_EDIT = "fresh as (select path from f where modified_at >= (select max(modified_at) from f) - 86400000), made as (select path from f where coalesce(generated = 1, false) and path not in (select path from fresh))"


@query(with_(FILES, _HEAVY_EDIT) + r"""select path, change from (
   select t.path, case when t.path in (select path from made) then 'added' when t.path in (select path from fresh) and regexp_replace(t.text, '\b(load|merge|flush|scan)', 'old_\1', 'g') <> t.text then 'changed' end as change from file_texts t where t.path is not null
   union all select 'gone/' || t.path, 'removed' from file_texts t where t.path in (select path from fresh)) where change is not null""")
def t5_changed_files(g: Graph) -> DataFrame:
    """What a sync finds to do after those edits."""
    before = _before(g).select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return Y.changed_files(before, g.raw("file_texts").select("path", "text"))


@query("""select run_id, directory, n_gone, n_gone >= 2 as full_sync from (select run_id, regexp_replace(path, '/?[^/]*$', '') as directory, count(distinct path) as n_gone from scans where content_hash is null and path is not null and run_id is not null group by 1, 2)""")
def t2_directory_removals(g: Graph) -> DataFrame:
    """Directories of which files could not be read any more, per run: from two on, one full sync takes the place of single removals."""
    rows = g.raw("scans").filter("content_hash is null and path is not null and run_id is not null").select("run_id", F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), "path").distinct()
    return rows.groupBy("run_id", "directory").agg(count().alias("n_gone")).withColumn("full_sync", F.col("n_gone") >= 2)


@query("""select run_id, failures, case when failures = 0 then 0 else least(30000, 1000 * cast(power(2, failures - 1) as bigint)) end as wait_ms, failures >= 5 as degraded from (
   select run_id, case when bad then cast(row_number() over (partition by streak, bad order by run_id) as bigint) else 0 end as failures from (select *, sum(case when bad then 0 else 1 end) over (order by run_id) as streak from (select run_id, status in ('failed', 'killed') as bad from runs where run_id is not null)))""")
def t9_backoff(g: Graph) -> DataFrame:
    """Wait before the next attempt after each run: doubled per failure in a row up to thirty seconds, degraded from the fifth on.  One row per run."""
    log = g.raw("runs").filter("run_id is not null").select("run_id", F.col("status").isin("failed", "killed").alias("bad"))
    streak = log.withColumn("streak", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(Window.orderBy("run_id")))
    failures = F.when(F.col("bad"), F.row_number().over(Window.partitionBy("streak", "bad").orderBy("run_id")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    rows = streak.select("run_id", failures.alias("failures"))
    wait = F.when(F.col("failures") == 0, F.lit(0)).otherwise(F.least(F.lit(30_000), 1000 * F.pow(F.lit(2.0), F.col("failures") - 1).cast("bigint"))).cast("bigint")
    return rows.select("run_id", "failures", wait.alias("wait_ms"), (F.col("failures") >= 5).alias("degraded"))


# --- symbols, audits and context


@query(with_(N, L, "m as (select distinct t.name as type_name, c.name from l join n t on t.id = l.source join n c on c.id = l.target and c.kind = 'method' where l.kind = 'contains' and t.kind in ('class', 'interface', 'struct', 'trait', 'protocol', 'enum', 'module', 'namespace') and t.name is not null and c.name is not null)")
       + """select distinct m.type_name || '.' || m.name as symbol, n.id from m join n on n.name = m.name where contains(n.qualified_name, m.type_name || '::' || m.name)
         or len(list_filter(string_split(n.file_path, '/'), lambda x: x = m.type_name or regexp_replace(x, '(.)\\.[^.]*$', '\\1') = m.type_name)) > 0""")  # fmt: skip
def c6_symbol_match(g: Graph) -> DataFrame:
    """Which symbols ``Type.method`` means, for every method: the name fits and the type stands in the qualified name or among the path's segments."""
    nodes = _nodes(g)
    asked = methods_of_types(nodes, g.links("contains")).filter("type_name is not null").select("type_name", "name").distinct()
    met = asked.join(nodes.select("id", "name", "qualified_name", "file_path"), "name")
    in_path = F.exists(F.split("file_path", "/"), lambda x: (x == F.col("type_name")) | (F.regexp_replace(x, r"(.)\.[^.]*$", "$1") == F.col("type_name")))
    fits = F.contains("qualified_name", F.concat("type_name", F.lit("::"), "name")) | in_path
    return met.filter(fits).select(F.concat_ws(".", "type_name", "name").alias("symbol"), "id").distinct()


_LOW = "regexp_matches(lower(path), '(^|/)(test|tests|__tests__|spec|e2e)/|\\.test\\.|\\.spec\\.|_test\\.|icon|i18n')"


@query(with_(FILES, f"g as (select path, split_part(path, '/', 1) as repository, {_LOW} as low from f)") + "select path from (select *, count(*) filter (where not low) over (partition by repository) as others from g) where not low or others < 2")
def c13_low_value_files(g: Graph) -> DataFrame:
    """Files to show per repository: tests, icons and translations only where fewer than two others remain."""
    low = F.lower("path").rlike(r"(^|/)(test|tests|__tests__|spec|e2e)/|\.test\.|\.spec\.|_test\.|icon|i18n")
    rows = g.files().select("path", F.substring_index("path", "/", 1).alias("repository"), low.alias("low"))
    others = rows.groupBy("repository").agg(F.count(F.when(~F.col("low"), 1)).alias("others"))
    return rows.join(others, "repository").filter(~F.col("low") | (F.col("others") < 2)).select("path")


@query(with_(N, L, FILES, "used as (select distinct t.file_path as path from l join n s on s.id = l.source join n t on t.id = l.target where l.kind <> 'contains' and s.file_path <> t.file_path)") + "select path from f where path not in (select path from used where path is not null) and (starts_with(path, 'amber-') or starts_with(path, 'russet-')) and not starts_with(path, 'amber-atlas/')")
def c16_audit_prefixes(g: Graph) -> DataFrame:
    """Orphan files below the prefixes an audit includes and not below those it leaves out."""
    return X.prefix_keep(d7_orphan_files(g), ["amber-", "russet-"], ["amber-atlas/"])


@query(with_(N, FILES) + """select distinct path, by_path, lane from (
   select n.file_path as path, r.file_path as by_path, 'candidate' as lane from (select file_path, unnest(candidates) as id from refs where file_path <> '') r join n on n.id = r.id where n.file_path <> r.file_path
   union all select f.path, n.file_path, 'import' from n join f on n.kind = 'import' and regexp_extract(f.path, '([^/]+?)(_[^/_]*)?\\.[^/.]*$', 1) = n.name and split_part(f.path, '/', 1) = split_part(n.file_path, '/', 1) and f.path <> n.file_path)""")
def d10_further_lanes(g: Graph) -> DataFrame:
    """Who refers to a file by further lanes: as an open reference's candidate, or by an import of its base name in the same repository."""
    nodes = g.nodes("kind", "name", "file_path")
    refs = g.raw("refs").filter("file_path <> ''").select(F.col("file_path").alias("by_path"), F.explode("candidates").alias("id")).distinct()
    a = refs.join(nodes.select("id", F.col("file_path").alias("path")), "id").filter("path <> by_path").select("path", "by_path", F.lit("candidate").alias("lane"))
    repository = lambda c: F.substring_index(c, "/", 1)
    files = g.files().select("path", repository("path").alias("repository"), F.regexp_extract("path", r"([^/]+?)(_[^/_]*)?\.[^/.]*$", 1).alias("name"))
    imports = nodes.filter("kind = 'import'").select("name", F.col("file_path").alias("by_path"), repository("file_path").alias("repository")).distinct()
    b = imports.join(files, ["name", "repository"]).filter("path <> by_path").select("path", "by_path", F.lit("import").alias("lane"))
    return a.unionByName(b).distinct()


_SEEDED = "sd as (select file_path as seed_set, id, row_number() over (partition by file_path order by start_line, start_column, id) as rk from n where kind in ('function', 'method', 'component') and file_path is not null), cc as (select target as id, count(*) as c from l where kind in ('calls', 'references', 'imports') group by 1), ct as (select sd.*, coalesce(cc.c, 0) as n_callers, max(coalesce(cc.c, 0)) over (partition by seed_set) as most from sd left join cc using (id))"


@query(with_(N, L, _SEEDED) + "select seed_set as file_path, id, n_callers from ct where rk = 1 or n_callers >= most // 4")
def e11_caller_tiers(g: Graph) -> DataFrame:
    """Of every file's callables the first, and those with at least a quarter of the most callers."""
    rows = g.nodes("kind", "file_path", "start_line", "start_column").filter(F.col("kind").isin(*C.CALLABLE_KINDS) & F.col("file_path").isNotNull())
    ranked = rows.select(F.col("file_path").alias("seed_set"), "id", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "start_column", "id")).alias("rank"))
    return C.caller_tiers(ranked, g.links()).withColumnRenamed("seed_set", "file_path")


def _explore_sql() -> str:
    ranked = SEARCH_SQL["s9_search_ranked"]
    terms = " + ".join(f"case when contains(lower(n.file_path), '{t}') or contains(lower(n.name), '{t}') then 1 else 0 end" for t in C.query_terms(TEXT))
    low = TEXT.replace(" ", "")
    return with_(N, L, f"hits as ({ranked})", f"seeds as (select id, rk from (select id, row_number() over (order by case when lower(name) = '{low}' then 0 else 1 end, score desc, id) as rk from hits) where rk <= 8)",
                 "cc as (select target as id, count(*) as c from l where kind in ('calls', 'references', 'imports') group by 1)", "cs as (select seeds.id, rk, coalesce(c, 0) as c from seeds join n on n.id = seeds.id and n.kind in ('function', 'method', 'component') left join cc on cc.id = seeds.id)",
                 "tier as (select id from cs where rk = (select min(rk) from cs) or c >= (select max(c) // 4 from cs))") + f"""
      select id, case min(r) when 0 then 'seed' when 1 then 'near' else 'rescued' end as role from (select id, 0 as r from seeds
        union all select source, 1 from l where target in (select id from seeds) and kind in ('calls', 'references', 'imports')
        union all select target, 1 from l where source in (select id from seeds) and kind in ('calls', 'references', 'imports', 'contains')
        union all select n.id, 2 from n where n.kind in ({', '.join(repr(k) for k in C.TYPE_KINDS)}) and n.id in (select target from l where kind in ('type_of', 'returns', 'references') and source in (select id from tier))
          and n.id not in (select id from seeds) and n.file_path not in (select file_path from n where id in (select id from seeds)) and {terms} < 2) group by id"""  # fmt: skip


@query(_explore_sql())
def h17_explore_context(g: Graph) -> DataFrame:
    """The context of a question: its eight best symbols, their neighbours and members, and the types their signatures speak of."""
    nodes = g.nodes("kind", "name", "qualified_name", "file_path", "language", "docstring", "signature")
    packed = TEXT.replace(" ", "")
    best = S.search(nodes, TEXT, 100).orderBy(F.when(F.lower("name") == packed, 0).otherwise(1), F.desc("score"), "id").limit(8)  # the eight best are the feature
    seeds = best.select("id", F.row_number().over(Window.orderBy(F.when(F.lower("name") == packed, 0).otherwise(1), F.desc("score"), "id")).alias("rank"))
    return C.explore(nodes, g.links(), seeds, TEXT)


@query(with_(N) + "select distinct n.id, n.name from refs r join n on n.name = r.reference_name and n.kind not in ('file', 'import') where r.language in ('ruby', 'c', 'java') and n.language <> r.language")
def h22_dynamic_reachability(g: Graph) -> DataFrame:
    """Symbols that open references of another language name: reachable although no edge says so."""
    return X.dynamically_named(_nodes(g), g.raw("refs"), ["ruby", "c", "java"])


# --- statistics, sets and renderings

_LINES = "x as (select kind, end_line - start_line + 1 as v from n where start_line is not null and end_line is not null)"


@query(with_(N, _LINES, "md as (select kind, quantile_disc(v, 0.5) as m from x group by 1)") + """select x.kind, count(*) as n, any_value(md.m) as median, quantile_disc(abs(v - md.m), 0.5) as mad, quantile_disc(v, 0.5) as p50, quantile_disc(v, 0.99) as p99 from x join md on md.kind is not distinct from x.kind group by x.kind""")
def e14_series_statistics(g: Graph) -> DataFrame:
    """Median, median absolute deviation, p50 and p99 of the symbols' length in lines, by kind."""
    rows = g.nodes("kind", "start_line", "end_line").filter("start_line is not null and end_line is not null").select("kind", (F.col("end_line") - F.col("start_line") + 1).alias("v"))
    return X.series_statistics(rows, "kind", "v")


@query(with_(FILES) + "select language, directory, count(*) as n_files from (select language, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda k: array_to_string(list_slice(string_split(path, '/'), 1, k), '/'))) as directory from f) group by 1, 2")
def e15_file_tree(g: Graph) -> DataFrame:
    """Files below every directory, by language: the rows of a tree rendering."""
    rows = g.files().select("language", F.explode(F.filter(directories(F.col("path")), lambda d: d != "")).alias("directory"))
    return rows.groupBy("language", "directory").agg(count().alias("n_files"))


@query("select ref_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as merged from (select ref_id, [reference_kind, language] || coalesce(candidates, []) || [language, reference_name] as l from refs)")
def g3_merge_unique(g: Graph) -> DataFrame:
    """Lists put together, each value once, at its first place."""
    parts = F.concat(F.array("reference_kind", "language"), F.coalesce("candidates", F.array().cast("array<string>")), F.array("language", "reference_name"))
    return g.raw("refs").select("ref_id", F.array_join(F.array_distinct(parts), ",").alias("merged"))


@query("select id from (select id, target, lag(target) over (partition by source, kind order by line nulls first, col nulls first, id) as prev, row_number() over (partition by source, kind order by line nulls first, col nulls first, id) as rk from edges where source is not null and target is not null and kind is not null) where rk = 1 or prev <> target")
def g7_adjacent_dedup(g: Graph) -> DataFrame:
    """Edges of a source in order of place, without those that repeat the target before them."""
    order = Window.partitionBy("source", "kind").orderBy(F.asc_nulls_first("line"), F.asc_nulls_first("col"), "id")
    rows = g.raw("edges").filter("source is not null and target is not null and kind is not null").select("id", "target", F.lag("target").over(order).alias("prev"))
    return rows.filter("prev is null or prev <> target").select("id")


@query("select id, source, target, kind, line, col from edges")
def b10_spill_and_replay(g: Graph) -> DataFrame:
    """Edges written as lines of JSON and read back."""
    return X.replayed(g.raw("edges").select("id", "source", "target", "kind", "line", "col"))


@query(with_(FILES) + "select path, cast(to_json({'path': path, 'language': language, 'size': size, 'generated': coalesce(generated = 1, false)}) as varchar) as json from f")
def b11_json_rows(g: Graph) -> DataFrame:
    """Files as JSON objects."""
    made = F.coalesce(F.col("generated") == 1, F.lit(False)).alias("generated")
    return g.files().select("path", F.to_json(F.struct("path", "language", "size", made)).alias("json"))


@query(with_(FILES) + "select path, strftime(make_timestamp(modified_at * 1000), '%Y-%m-%d %H:%M:%S') as modified, indexed_at - modified_at as lag_ms from f where modified_at is not null")
def n12_epoch_millis(g: Graph) -> DataFrame:
    """Modification times in words, and how long after them a file was indexed."""
    at = F.date_format(F.timestamp_millis("modified_at"), "yyyy-MM-dd HH:mm:ss")
    return g.files().filter("modified_at is not null").select("path", at.alias("modified"), (F.col("indexed_at") - F.col("modified_at")).alias("lag_ms"))


# --- source text


@query("select path, position('return' in text) - 1 as at_char, len(left(text, position('return' in text) - 1)) - len(replace(left(text, position('return' in text) - 1), chr(10), '')) + 1 as line, trim(replace(substr(text, greatest(1, position('return' in text) - 20), 46), chr(10), ' '), ' ') as snippet from file_texts where path is not null and position('return' in text) > 0")
def n15_snippets(g: Graph) -> DataFrame:
    """The first return of every file: its offset, line and surroundings."""
    return X.first_places(g.raw("file_texts"), "return", 20)


_COMMENT = r"^\s*(?:///?!?|#+|\*+/?|/\*+|--+)\s?(.*?)\s*(?:\*+/)?$"


@query(with_(N, "ln as (select path, unnest(parts) as code, generate_subscripts(parts, 1) as line from (select path, string_split_regex(text, '\\r\\n|\\n|\\r') as parts from file_texts where path is not null and text is not null))",
             f"cm as (select path, line, regexp_extract(code, '{_COMMENT}', 1) as said, line - row_number() over (partition by path order by line) as block from ln where regexp_matches(code, '{_COMMENT}'))",
             "bl as (select path, max(line) as last_line, trim(string_agg(said, ' ' order by line)) as docstring from cm group by path, block)")
       + "select n.id, bl.docstring from n join bl on bl.path = n.file_path and bl.last_line = n.start_line - 1 where n.kind in ('function', 'method', 'class') and bl.docstring <> ''")
def x6_preceding_comments(g: Graph) -> DataFrame:
    """The comment block that ends on the line before a symbol, without its markers."""
    return X.preceding_comments(g.raw("file_texts"), g.nodes("kind", "file_path", "start_line").filter(F.col("kind").isin("function", "method", "class")))


@query(r"""select lang, count(*) as n_blocks, cast(sum(length(code)) as bigint) as n_chars from (select lower(regexp_extract(part, '^(\w+)', 1)) as lang, regexp_replace(part, '^[^\n]*\n?', '') as code from (
  select unnest(parts) as part, generate_subscripts(parts, 1) as k, len(parts) as n from (select string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^```') as parts from documents where text is not null)) where k % 2 = 0 and k < n) where lang <> '' group by 1""")
def x9_embedded_blocks(g: Graph) -> DataFrame:
    """Code in another language inside texts, by language."""
    blocks = X.fenced_blocks(g.raw("documents"))
    return blocks.groupBy("lang").agg(count().alias("n_blocks"), F.sum(F.length("code")).alias("n_chars"))


# --- lookups and exports


@query(with_(N) + """select 'name' as lane, id from n where name in (select reference_name from refs) union all select 'lower_name', id from n where lower(name) in (select lower(reference_name) from refs)
  union all select 'kind', id from n where kind = 'namespace' union all select 'file', id from n where file_path in (select path from files where generated = 1) union all select 'qualified_name', id from n where qualified_name in (select name from n)""")
def a9_lookups(g: Graph) -> DataFrame:
    """Symbols by name, by name without case, by kind, by file and by qualified name: each lane one semi-join with its keys."""
    nodes, refs = g.nodes("kind", "name", "qualified_name", "file_path"), g.raw("refs").filter("reference_name is not null").select("reference_name").distinct()
    made = g.raw("files").filter("generated = 1 and path is not null").select(F.col("path").alias("file_path")).distinct()
    lanes = {
        "name": nodes.join(refs.withColumnRenamed("reference_name", "name"), "name", "left_semi"),
        "lower_name": nodes.withColumn("k", F.lower("name")).join(refs.select(F.lower("reference_name").alias("k")).distinct(), "k", "left_semi"),
        "kind": nodes.filter("kind = 'namespace'"),
        "file": nodes.join(made, "file_path", "left_semi"),
        "qualified_name": nodes.join(nodes.select(F.col("name").alias("qualified_name")).distinct(), "qualified_name", "left_semi"),
    }
    out = None
    for lane, df in lanes.items():
        part = df.select(F.lit(lane).alias("lane"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(with_(N, E) + "select true as directed, true as multigraph, (select count(*) from n) as n_nodes, (select count(*) from e) as n_links, (select string_agg(kind, ',' order by kind) from (select distinct kind from e)) as link_kinds")
def b9_export_envelope(g: Graph) -> DataFrame:
    """What stands around the nodes and links of an export."""
    links = g.edges().agg(count().alias("n_links"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("link_kinds"))
    return links.select(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), g.nodes("kind").agg(count().alias("n")).scalar().alias("n_nodes"), "n_links", "link_kinds")


@query("select ref_id, from_node_id as source, reference_name as name, reference_kind as relation, file_path as source_file, line, array_to_string(candidates, '|') as candidates from refs")
def a11_export_references(g: Graph) -> DataFrame:
    """The open references of an export."""
    return g.raw("refs").select("ref_id", F.col("from_node_id").alias("source"), F.col("reference_name").alias("name"), F.col("reference_kind").alias("relation"), F.col("file_path").alias("source_file"), "line", F.array_join("candidates", "|").alias("candidates"))


@query(with_(FILES) + "select path as id, 'file' as label, language, size, coalesce(generated = 1, false) as generated, coalesce(array_to_string(errors, '|'), '') as errors from f")
def a11_export_files(g: Graph) -> DataFrame:
    """The files of an export."""
    return g.files().select(F.col("path").alias("id"), F.lit("file").alias("label"), "language", "size", F.coalesce(F.col("generated") == 1, F.lit(False)).alias("generated"), F.coalesce(F.array_join("errors", "|"), F.lit("")).alias("errors"))


@query(with_(N, E) + """select part, n from (select 'resolved' as part, count(*) as n from e where json_extract_string(metadata, '$.resolvedBy') is not null union all select 'unresolved', count(*) from refs
  union all select 'total', (select count(*) from e where json_extract_string(metadata, '$.resolvedBy') is not null) + (select count(*) from refs) union all select 'by:' || json_extract_string(metadata, '$.resolvedBy'), count(*) from e where json_extract_string(metadata, '$.resolvedBy') is not null group by 1)""")
def e9_resolution_totals(g: Graph) -> DataFrame:
    """Resolved references, open ones, both together, and the resolved by strategy."""
    by = F.get_json_object("metadata", "$.resolvedBy")
    strategies = g.edges().filter(by.isNotNull()).groupBy(F.concat(F.lit("by:"), by).alias("part")).agg(count().alias("n"))
    n_open = g.raw("refs").agg(count().alias("n"))
    resolved = g.edges().agg(F.count(by).alias("n"))
    total = resolved.select((F.col("n") + n_open.scalar()).alias("n"))
    rows = [resolved.select(F.lit("resolved").alias("part"), "n"), n_open.select(F.lit("unresolved").alias("part"), "n"), total.select(F.lit("total").alias("part"), "n")]
    return strategies.unionByName(rows[0]).unionByName(rows[1]).unionByName(rows[2])


_PINS = "pins as (select distinct reference_name as name, case when strpos(reference_name, '_') > 0 then split_part(reference_name, '_', -1) else lower(reference_name) end as pin from refs where reference_name is not null)"


@query(with_(FILES, _PINS, "b as (select path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '(_[^_.]*)?\\.[^.]*$', '') as stem from f)") + "select distinct pins.pin, b.path, b.path is null as missing from pins left join b on b.stem = pins.pin")
def c8_pins_and_misses(g: Graph) -> DataFrame:
    """Files pinned by base name, and the pins that meet none: the last word of every open reference taken as a pin."""
    name = F.col("reference_name")
    pin = F.when(F.contains(name, F.lit("_")), F.element_at(F.split(name, "_"), -1)).otherwise(F.lower(name))
    pins = g.raw("refs").filter("reference_name is not null").select(pin.alias("pin")).distinct()
    stems = g.files().select("path", F.regexp_replace(basename(F.col("path")), r"(_[^_.]*)?\.[^.]*$", "").alias("pin"))
    return pins.join(stems, "pin", "left").select("pin", "path", F.col("path").isNull().alias("missing")).distinct()


@query(with_(N, L) + """select file_path, n_symbols, n_callers, case when n_callers >= greatest(1, most // 4) then 'high' when n_callers > 0 then 'some' else 'none' end as tier from (
  select file_path, n_symbols, n_callers, max(n_callers) over () as most from (select n.file_path, count(*) as n_symbols, cast(coalesce(sum(c.k), 0) as bigint) as n_callers from n left join (select target, count(distinct source) as k from l where kind = 'calls' group by 1) c on c.target = n.id where n.kind <> 'file' group by 1))""")
def e12_file_tiers(g: Graph) -> DataFrame:
    """Files by how much they are called: a quarter of the most called file's callers make the upper tier."""
    called = g.links("calls").select("source", "target").distinct().groupBy(F.col("target").alias("id")).agg(count().alias("k"))
    files = g.nodes("kind", "file_path").filter("kind <> 'file'").join(called, "id", "left").groupBy("file_path").agg(count().alias("n_symbols"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_callers"))
    most = files.agg(F.max("n_callers").alias("m")).scalar()
    tier = F.when(F.col("n_callers") >= F.greatest(F.lit(1), F.floor(most / 4)), "high").when(F.col("n_callers") > 0, "some").otherwise("none")
    return files.select("file_path", "n_symbols", "n_callers", tier.alias("tier"))


@query(with_(N, "old as (select id, arg_min(name, updated_at) as name, arg_min(coalesce(docstring, ''), updated_at) as d from nodes where id is not null group by id)", "a as (select id, name, d from old)", "b as (select id, name, coalesce(docstring, '') as d from n)")
       + "select id, name, min(side) as side, count(*) as n_sides from (select id, name, d, 'before' as side from (select * from a except select * from b) union all select id, name, d, 'after' from (select * from b except select * from a)) group by id, name")
def g4_symmetric_difference(g: Graph) -> DataFrame:
    """Symbols that stand on one side only when first and newest sightings are compared as sets of (id, name, documentation)."""
    seen = g.raw("nodes").filter("id is not null").withColumn("d", F.coalesce("docstring", F.lit("")))
    before = seen.groupBy("id").agg(F.min_by(F.struct("name", "d"), "updated_at").alias("x")).select("id", "x.name", "x.d")
    after = g.nodes("name", "docstring").select("id", "name", F.coalesce("docstring", F.lit("")).alias("d"))
    both = before.withColumn("side", F.lit(-1)).unionByName(after.withColumn("side", F.lit(1))).groupBy("id", "name", "d").agg(F.sum("side").alias("side")).filter("side <> 0")
    return both.groupBy("id", "name").agg(F.when(F.max("side") > 0, "after").otherwise("before").alias("side"), count().alias("n_sides"))
