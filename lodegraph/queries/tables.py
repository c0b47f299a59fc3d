"""Scans, mutations, predicates, joins, aggregates and set operations over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.paths import LANGUAGE_OF, NON_PRODUCTION, CAMEL_TEST, GENERATED_PATH, IGNORED_DIRS, TEST_FILE, basename, dirname, glob_regex, ignored, is_generated_path, is_non_production, is_path_shaped, is_test_file, language_of, normalized, proximity
from lodegraph.functions.names import kebab_to_pascal, node_id, plain_word, segments, snake_to_camel, stems
from lodegraph.operators.adjacency import degrees, file_dependencies, reference_sites, strongest
from lodegraph.operators.store import Graph, delete_files
from lodegraph.queries.sql import DEPS, E, L, N, R, with_
from lodegraph.queries.sql import F as FILES

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


_CASES = "case " + " ".join(f"when ext = '{k}' then '{v}'" for k, v in LANGUAGE_OF.items()) + " else 'unknown' end"


# --- scans


@query(with_(N) + "select id, name, file_path from n where kind = 'class' and starts_with(lower(name), 'a')")
def a9_nodes_by_kind_and_name(g: Graph) -> DataFrame:
    return g.nodes("kind", "name", "file_path").filter((F.col("kind") == "class") & F.lower("name").startswith("a")).select("id", "name", "file_path")


@query(with_(N) + "select id, kind, name from n where id in (select from_node_id from refs)")
def a8_nodes_by_ids(g: Graph) -> DataFrame:
    """Batch lookup of the nodes that hold unresolved references."""
    ids = g.raw("refs").select(F.col("from_node_id").alias("id")).distinct()
    return g.nodes("kind", "name").join(ids, "id", "left_semi").select("id", "kind", "name")


@query(with_(FILES) + f"select path, {_CASES} as detected from (select path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as ext from f)")
def a4_language_map(g: Graph) -> DataFrame:
    return g.files().select("path", language_of(F.col("path")).alias("detected"))


_IGNORE = ["tests/", "*.min.js", "!*.bundle.js", "src/vendor", "!indigo-signal/tests/"]
_DIRS = "|".join(d.replace(".", "\\.") for d in IGNORED_DIRS)


@query(with_(FILES) + f"""select path, case when regexp_matches(path, '(^|/)(indigo-signal/tests)(/|$)') and regexp_matches(path, '^indigo-signal/tests(/|$)') then false
  when regexp_matches(path, '^src/vendor(/|$)') then true when regexp_matches(path, '(^|/)[^/]*\\.bundle\\.js(/|$)') then false
  when regexp_matches(path, '(^|/)[^/]*\\.min\\.js(/|$)') then true when regexp_matches(path, '(^|/)tests(/|$)') then true
  else regexp_matches(path, '(^|/)({_DIRS})/') end as is_ignored from f""")
def a2_ignore_fold(g: Graph) -> DataFrame:
    return g.files().select("path", ignored(F.col("path"), _IGNORE).alias("is_ignored"))


# What a C header shows of other languages.
_CPP = r"\bnamespace\b|\bclass\s+\w+\s*[:{]|\b(?:class|struct)\s+[A-Z][A-Z0-9_]+\s+\w+\s*(?:final\s*)?[:{]|\btemplate\s*<|\b(?:public|private|protected)\s*:|\bvirtual\b|\busing\s+(?:namespace\b|\w+\s*=)"
_OBJC = r"@(?:interface|implementation|protocol|synthesize)\b"


@query(f"""select path, case when not regexp_matches(path, '\\.h$') then 'none' when regexp_matches(substr(text, 1, 8192), '{_OBJC}') then 'objc' when regexp_matches(substr(text, 1, 8192), '{_CPP}') then 'cpp' else 'c' end as header_language,
  regexp_matches(substr(text, 1, 8192), '{_CPP}') as looks_like_cpp, regexp_matches(substr(text, 1, 8192), '{_OBJC}') as looks_like_objc from file_texts where path is not null and text is not null""")
def a5_header_sniff(g: Graph) -> DataFrame:
    """What the first 8,192 characters show of C++ and Objective-C; for headers it decides the language."""
    head = F.substring("text", 1, 8192)
    cpp, objc = head.rlike(_CPP), head.rlike(_OBJC)
    language = F.when(~F.col("path").rlike(r"\.h$"), "none").when(objc, "objc").when(cpp, "cpp").otherwise("c")
    return g.raw("file_texts").filter("path is not null and text is not null").select("path", language.alias("header_language"), cpp.alias("looks_like_cpp"), objc.alias("looks_like_objc"))


@query(with_(FILES) + "select path, size, case when size > 4096 then 'file exceeds the size limit' end as message from f")
def a6_size_gate(g: Graph) -> DataFrame:
    return g.files().select("path", "size", F.when(F.col("size") > 4096, F.lit("file exceeds the size limit")).alias("message"))


@query(with_(N) + "select r.ref_id, r.reference_name from refs r where r.reference_name in (select name from n where kind = 'method')")
def a13_refs_by_names(g: Graph) -> DataFrame:
    names = g.nodes("kind", "name").filter("kind = 'method'").select(F.col("name").alias("reference_name")).distinct()
    return g.raw("refs").join(names, "reference_name", "left_semi").select("ref_id", "reference_name")


@query("select ref_id, from_node_id, reference_name from refs where ref_id > 500 order by ref_id limit 1000")
def a12_ref_cursor(g: Graph) -> DataFrame:
    """A page behind a cursor; the limit is the page size."""
    return g.raw("refs").filter("ref_id > 500").orderBy("ref_id").limit(1000).select("ref_id", "from_node_id", "reference_name")


# --- mutations


@query(with_(N) + "select id, kind, name, updated_at from n")
def b1_upsert_latest(g: Graph) -> DataFrame:
    return g.nodes("kind", "name", "updated_at").select("id", "kind", "name", "updated_at")


@query(with_(E) + "select id, source, target, kind, line, col from e")
def b2_edge_identity_dedup(g: Graph) -> DataFrame:
    return g.edges().select("id", "source", "target", "kind", "line", "col")


@query(with_(R) + "select ref_id from r")
def b3_refs_with_source(g: Graph) -> DataFrame:
    return g.refs().select("ref_id")


@query(with_(N, FILES, """gone as (select path from f where generated = 1)""", "dead as (select id from n where file_path in (select path from gone))") + """
  select 'nodes' as part, count(*) as n_left from n where id not in (select id from dead)
  union all select 'edges', count(*) from edges where coalesce(source, '') not in (select id from dead) and coalesce(target, '') not in (select id from dead)
  union all select 'refs', count(*) from refs where coalesce(from_node_id, '') not in (select id from dead)
  union all select 'files', count(*) from f where path not in (select path from gone)""")
def b5_delete_cascade(g: Graph) -> DataFrame:
    """What is left when the generated files go, with everything that hangs on them."""
    files = g.files()
    tables = {"nodes": g.nodes("file_path"), "edges": g.raw("edges"), "refs": g.raw("refs"), "files": files}
    left = delete_files(tables, files.filter("generated = 1").select("path"))
    parts = [df.agg(count().alias("n_left")).select(F.lit(name).alias("part"), "n_left") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("select ref_id from refs r where not exists (select 1 from edges e where e.source = r.from_node_id and e.line = r.line and e.kind <> 'contains')")
def b6_refs_without_site(g: Graph) -> DataFrame:
    """References left when those at sites that hold an edge are deleted."""
    sites = g.raw("edges").filter("kind <> 'contains' and line is not null").select(F.col("source").alias("from_node_id"), "line").distinct()
    return g.raw("refs").join(sites, ["from_node_id", "line"], "left_anti").select("ref_id")


@query(with_(N, E) + "select e.id from e join n on n.id = e.source where not (e.kind <> 'contains' and n.language = 'ruby')")
def b7_delete_resolved_edges(g: Graph) -> DataFrame:
    """Edges left when the resolved ones from Ruby files are deleted; containment stays."""
    met = g.edges().join(g.nodes("language").withColumnRenamed("id", "source"), "source")
    return met.filter(~((F.col("kind") != "contains") & F.coalesce(F.col("language") == "ruby", F.lit(False)))).select("id")


@query(with_(E) + "select source, target, kind as relation, line, json_extract_string(metadata, '$.resolvedBy') as resolved_by from e")
def b9_export_links(g: Graph) -> DataFrame:
    """The links of a node-link export."""
    return g.edges().select("source", "target", F.col("kind").alias("relation"), "line", F.get_json_object("metadata", "$.resolvedBy").alias("resolved_by"))


@query(with_(N) + "select id, name as label, kind, case when kind = 'file' then 'file' else 'code' end as file_type, file_path as source_file, qualified_name, language, start_line, end_line, signature from n")
def b9_export_nodes(g: Graph) -> DataFrame:
    return g.nodes().select("id", F.col("name").alias("label"), "kind", F.when(F.col("kind") == "file", "file").otherwise("code").alias("file_type"), F.col("file_path").alias("source_file"), "qualified_name", "language", "start_line", "end_line", "signature")


# --- predicates


@query(with_(FILES) + "select path from f where regexp_matches(path, '^(?:.*/)?tests/[^/]*\\.py$') or starts_with(path, 'amber-atlas/')")
def c4_file_glob(g: Graph) -> DataFrame:
    return g.files().filter(F.col("path").rlike(glob_regex("**/tests/*.py")) | F.col("path").startswith("amber-atlas/")).select("path")


@query(with_(N) + "select id from n where qualified_name = name or ends_with(qualified_name, '.' || name) or ends_with(qualified_name, '::' || name) or ends_with(qualified_name, '/' || name)")
def c7_exact_symbol(g: Graph) -> DataFrame:
    """Symbols whose qualified name ends in their own name behind a separator."""
    q, name = F.col("qualified_name"), F.col("name")
    ends = (q == name) | F.endswith(q, F.concat(F.lit("."), name)) | F.endswith(q, F.concat(F.lit("::"), name)) | F.endswith(q, F.concat(F.lit("/"), name))
    return g.nodes("name", "qualified_name").filter(ends).select("id")


@query(with_(FILES) + "select path from f where path = 'tests/a.py' or ends_with(path, '/index.ts') or ends_with(path, '/lib/' || regexp_extract(path, '([^/]+)$', 1))")
def c8_file_pin(g: Graph) -> DataFrame:
    path = F.col("path")
    return g.files().filter((path == "tests/a.py") | path.endswith("/index.ts") | F.endswith(path, F.concat(F.lit("/lib/"), basename(path)))).select("path")


@query(with_(FILES) + f"select path, regexp_matches(path, '{TEST_FILE}') as is_test from f")
def c9_is_test_file(g: Graph) -> DataFrame:
    return g.files().select("path", is_test_file(F.col("path")).alias("is_test"))


@query(with_(FILES) + f"select path, regexp_matches(path, '{NON_PRODUCTION}') or regexp_matches(path, '{CAMEL_TEST}') as is_non_production from f")
def c10_non_production(g: Graph) -> DataFrame:
    return g.files().select("path", is_non_production(F.col("path")).alias("is_non_production"))


@query(with_(FILES) + f"select path, regexp_matches(path, '{GENERATED_PATH}') as is_generated from f")
def c11_generated_path(g: Graph) -> DataFrame:
    return g.files().select("path", is_generated_path(F.col("path")).alias("is_generated"))


_BANNER = r"(?i)^\s*(//|#|/?\*|--|<!--).*(@generated|code generated .*do not edit|auto-?generated by|generated by .*do not (edit|modify)|this file (was|is) (automatically |auto-?)(generated|created)|do not edit this file)"


@query(f"select path from file_texts where text is not null and len(list_filter(list_slice(string_split(substr(text, 1, 8192), chr(10)), 1, 60), lambda x: regexp_matches(x, '{_BANNER}'))) > 0")
def c12_generated_banner(g: Graph) -> DataFrame:
    """Files with a generator's banner on a comment line of their head; a cheap stem test comes first."""
    head = F.slice(F.split(F.substring("text", 1, 8192), "\n"), 1, 60)
    rows = g.raw("file_texts").filter(F.lower("text").rlike("generat|edit|created"))
    return rows.filter(F.exists(head, lambda x: x.rlike(_BANNER))).select("path")


@query("select ref_id, (regexp_matches(reference_name, '/|\\.[A-Za-z0-9]{1,5}$') and not regexp_matches(reference_name, '\\s|^[a-z][a-z0-9+.-]*:')) or starts_with(reference_name, 'res://') as path_shaped from refs where reference_name is not null")
def c14_path_shaped(g: Graph) -> DataFrame:
    return g.raw("refs").filter("reference_name is not null").select("ref_id", is_path_shaped(F.col("reference_name")).alias("path_shaped"))


# --- joins


@query(with_(N, L, DEPS) + "select path, depends_on from deps")
def d3_dependency_files(g: Graph) -> DataFrame:
    return file_dependencies(g.links(), g.nodes("file_path"))


@query(with_(N, L, DEPS) + "select depends_on as path, count(*) as n_dependents from deps group by 1")
def d2_dependent_files(g: Graph) -> DataFrame:
    return file_dependencies(g.links(), g.nodes("file_path")).groupBy(F.col("depends_on").alias("path")).agg(count().alias("n_dependents"))


@query(with_(N, E) + """select distinct t.file_path as path, e.source as from_node_id, case when e.line is not null and e.col is not null then e.line end as line,
  case when e.line is not null and e.col is not null then e.col end as col from e join n t on t.id = e.target join n s on s.id = e.source where e.kind <> 'contains' and s.file_path <> t.file_path""")
def d4_reference_sites(g: Graph) -> DataFrame:
    return reference_sites(g.edges(), g.nodes("file_path"))


@query(with_(N, L) + "select distinct t.name as target_name, s.file_path as path from l join n t on t.id = l.target join n s on s.id = l.source where l.kind <> 'contains' and t.kind = 'class'")
def d5_files_using_names(g: Graph) -> DataFrame:
    nodes = g.nodes("name", "kind", "file_path")
    named = nodes.filter("kind = 'class'").select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    met = g.links().filter("kind <> 'contains'").select("source", "target").distinct().join(named, "target")
    return met.join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("path")), "source").select("target_name", "path").distinct()


@query(with_(N, L, FILES, "used as (select distinct t.file_path as path from l join n s on s.id = l.source join n t on t.id = l.target where l.kind <> 'contains' and s.file_path <> t.file_path)") + "select path from f where path not in (select path from used where path is not null)")
def d7_orphan_files(g: Graph) -> DataFrame:
    """Files that no other file refers to."""
    used = file_dependencies(g.links(), g.nodes("file_path")).select(F.col("depends_on").alias("path")).distinct()
    return g.files().select("path").join(used, "path", "left_anti")


@query("select id, source, target from edges where target not in (select id from nodes where id is not null)")
def d8_dangling_edges(g: Graph) -> DataFrame:
    known = g.raw("nodes").filter("id is not null").select(F.col("id").alias("target")).distinct()
    return g.raw("edges").filter("target is not null").join(known, "target", "left_anti").select("id", "source", "target")


@query(with_(N, L) + """select distinct path, by_path, lane from (
  select t.file_path as path, s.file_path as by_path, 'edge' as lane from l join n s on s.id = l.source join n t on t.id = l.target where l.kind in ('calls', 'references', 'imports', 'extends') and s.file_path <> t.file_path
  union all select n.file_path, r.file_path, 'reference' from refs r join n on n.name = r.reference_name and n.kind in ('class', 'struct', 'interface') where r.file_path <> '' and r.file_path <> n.file_path)""")
def d9_reverse_lanes(g: Graph) -> DataFrame:
    """Who refers to a file: by edges, or by unresolved names of its types."""
    nodes = g.nodes("file_path", "kind", "name")
    by_edge = file_dependencies(g.links("calls", "references", "imports", "extends"), nodes).select(F.col("depends_on").alias("path"), F.col("path").alias("by_path"), F.lit("edge").alias("lane"))
    types = nodes.filter(F.col("kind").isin("class", "struct", "interface")).select(F.col("name").alias("reference_name"), F.col("file_path").alias("path"))
    refs = g.raw("refs").filter("file_path <> ''").select("reference_name", F.col("file_path").alias("by_path")).distinct()
    by_name = refs.join(types, "reference_name").filter("path <> by_path").select("path", "by_path", F.lit("reference").alias("lane"))
    return by_edge.unionByName(by_name).distinct()


@query(with_(N) + "select distinct r.reference_name, n.id from refs r join n on regexp_extract(n.qualified_name, '([^./:]+)$', 1) = regexp_extract(r.reference_name, '([^./:]+)$', 1) where ends_with(n.qualified_name, r.reference_name)")
def d12_suffix_join(g: Graph) -> DataFrame:
    """Qualified names that end in a reference's name: blocked on the last segment, then compared."""
    last = lambda c: F.regexp_extract(c, "([^./:]+)$", 1)
    names = g.raw("refs").select("reference_name").filter("reference_name is not null").distinct().withColumn("last", last("reference_name"))
    nodes = g.nodes("qualified_name").withColumn("last", last("qualified_name"))
    return names.join(nodes, "last").filter(F.endswith("qualified_name", "reference_name")).select("reference_name", "id")


_RANGE = "from refs r join n on n.file_path = r.file_path and n.kind in ('function', 'method') and r.line between n.start_line and n.end_line"


@query(with_(N) + f"select r.ref_id, n.id {_RANGE}")
def d13_interval_join(g: Graph) -> DataFrame:
    """Functions around a reference, by line range within its file."""
    refs = g.raw("refs").select("ref_id", "file_path", "line")
    nodes = g.nodes("kind", "file_path", "start_line", "end_line").filter(F.col("kind").isin("function", "method"))
    return refs.join(nodes, "file_path").filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("ref_id", "id")


@query(with_(N) + "select r.ref_id, coalesce(max(n.start_line), 1) as scope_start from refs r left join n on n.file_path = r.file_path and n.language = r.language and n.kind in ('function', 'method') and r.line between n.start_line and n.end_line group by r.ref_id")
def d14_innermost_scope(g: Graph) -> DataFrame:
    """The start of the innermost enclosing function, 1 at file level."""
    refs = g.raw("refs").select("ref_id", "file_path", "line", "language")
    nodes = g.nodes("kind", "file_path", "language", "start_line", "end_line").filter(F.col("kind").isin("function", "method"))
    met = refs.join(nodes, ["file_path", "language"], "left")
    start = F.max(F.when(F.col("line").between(F.col("start_line"), F.col("end_line")), F.col("start_line")))
    return met.groupBy("ref_id").agg(F.coalesce(start, F.lit(1)).alias("scope_start"))


@query(with_(N, L) + """select distinct l.source as from_node_id, t.name, i.id as import_id from l join n s on s.id = l.source join n t on t.id = l.target
  join n i on i.kind = 'import' and i.file_path = s.file_path and i.name in (select unnest(string_split(lower(regexp_replace(t.name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_'))) where l.kind in ('calls', 'instantiates', 'references')""")
def d17_imports_of_refs(g: Graph) -> DataFrame:
    """Used names of which a word is an imported name of the using file."""
    nodes = g.nodes("kind", "name", "file_path")
    imports = nodes.filter("kind = 'import'").select(F.col("id").alias("import_id"), F.col("name").alias("word"), "file_path")
    used = g.links("calls", "instantiates", "references").join(nodes.select(F.col("id").alias("source"), "file_path"), "source").join(nodes.select(F.col("id").alias("target"), "name"), "target").select(F.col("source").alias("from_node_id"), "file_path", "name").distinct()
    words = F.split(F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2")), "_")
    return used.withColumn("word", F.explode(F.array_distinct(words))).join(imports, ["file_path", "word"]).select("from_node_id", "name", "import_id").distinct()


_SHARED = """(select count(*) from range(1, 9) as k(i) where
   list_slice(string_split(regexp_replace(a, '/?[^/]*$', ''), '/'), 1, k.i) = list_slice(string_split(regexp_replace(b, '/?[^/]*$', ''), '/'), 1, k.i)
   and k.i <= least(len(string_split(regexp_replace(a, '/?[^/]*$', ''), '/')), len(string_split(regexp_replace(b, '/?[^/]*$', ''), '/'))) and regexp_replace(a, '/?[^/]*$', '') <> '' and regexp_replace(b, '/?[^/]*$', '') <> '')"""


@query(with_(N) + f"""select ref_id, id, near from (select *, row_number() over (partition by ref_id order by near desc, b, id) as rk from (
   select ref_id, id, b, least(15 * {_SHARED}, 80) as near from (select r.ref_id, n.id, r.file_path as a, n.file_path as b from refs r join n on n.name = r.reference_name and n.kind in ('function', 'method', 'class')))) where rk = 1""")
def d18_nearest_candidate(g: Graph) -> DataFrame:
    """Of all symbols of a reference's name, the one with most leading directories in common."""
    refs = g.raw("refs").select("ref_id", F.col("reference_name").alias("name"), F.col("file_path").alias("a"))
    nodes = g.nodes("kind", "name", "file_path").filter(F.col("kind").isin("function", "method", "class")).select("id", "name", F.col("file_path").alias("b"))
    met = refs.join(nodes, "name").select("ref_id", "id", "b", proximity(F.col("a"), F.col("b")).cast("bigint").alias("near"))
    best = met.groupBy("ref_id").agg(F.min_by(F.struct("id", "near"), F.struct((-F.col("near")).alias("n"), "b", "id")).alias("best"))
    return best.select("ref_id", "best.id", "best.near")


# --- aggregates


@query(with_(N, E, FILES) + "select 'nodes' as part, count(*) as n_rows from n union all select 'edges', count(*) from e union all select 'files', count(*) from f union all select 'refs', count(*) from refs")
def e1_counts(g: Graph) -> DataFrame:
    parts = {"nodes": g.nodes("kind"), "edges": g.edges(), "files": g.files(), "refs": g.raw("refs")}
    out = [df.agg(count().alias("n_rows")).select(F.lit(k).alias("part"), "n_rows") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(with_(N) + "select kind, count(*) as n_nodes from n group by kind")
def e2_nodes_by_kind(g: Graph) -> DataFrame:
    return g.nodes("kind").groupBy("kind").agg(count().alias("n_nodes"))


@query(with_(FILES) + "select language, count(*) as n_files from f group by language")
def e3_files_by_language(g: Graph) -> DataFrame:
    return g.files().groupBy("language").agg(count().alias("n_files"))


@query(with_(N, FILES) + "select f.path, count(n.id) as n_nodes from f left join n on n.file_path = f.path group by f.path")
def e4_nodes_per_file(g: Graph) -> DataFrame:
    per = g.nodes("file_path").groupBy(F.col("file_path").alias("path")).agg(count().alias("n"))
    return g.files().select("path").join(per, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_nodes"))


@query(with_(N) + "select name, min(kind) as kind from n where kind not in ('file', 'import') group by name")
def e6_distinct_names(g: Graph) -> DataFrame:
    return g.nodes("kind", "name").filter(~F.col("kind").isin("file", "import")).groupBy("name").agg(F.min("kind").alias("kind"))


@query(with_(N, E) + "select n.id, (select count(*) from e where e.target = n.id and e.kind <> 'contains') as in_degree, (select count(*) from e where e.source = n.id and e.kind <> 'contains') as out_degree from n")
def e8_degrees(g: Graph) -> DataFrame:
    return degrees(g.edges(), g.nodes("kind"))


@query(with_(E) + "select coalesce(json_extract_string(metadata, '$.resolvedBy'), '') as resolved_by, count(*) as n_edges, round(avg(cast(json_extract_string(metadata, '$.confidence') as double)), 6) as mean_confidence from e where kind <> 'contains' group by 1")
def e9_resolution_stats(g: Graph) -> DataFrame:
    edges = g.edges().filter("kind <> 'contains'")
    by = F.coalesce(F.get_json_object("metadata", "$.resolvedBy"), F.lit("")).alias("resolved_by")
    return edges.groupBy(by).agg(count().alias("n_edges"), F.round(F.avg(F.get_json_object("metadata", "$.confidence").cast("double")), 6).alias("mean_confidence"))


_SEG = "string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+')"


@query(with_(N) + f"select segment, count(*) as n_names from (select distinct name, unnest({_SEG}) as segment from n where kind not in ('file', 'import')) where segment <> '' group by segment")
def e10_segment_rarity(g: Graph) -> DataFrame:
    names = g.nodes("kind", "name").filter(~F.col("kind").isin("file", "import") & F.col("name").isNotNull()).select("name").distinct()
    return names.select("name", F.explode(F.array_distinct(segments(F.col("name")))).alias("segment")).groupBy("segment").agg(count().alias("n_names"))


@query(with_(E) + "select kind, source, target, rk as rank from (select kind, source, target, row_number() over (partition by kind order by source, target) as rk from (select distinct kind, source, target from e)) where rk <= 10")
def e13_relationship_map(g: Graph) -> DataFrame:
    """The first ten relations per kind."""
    return strongest(g.links(), ["kind"], ["source", "target"], 10).select("kind", "source", "target", F.col("rank"))


@query(with_(N) + "select file_path, kind, count(*) as n_symbols, arg_min(name, row(start_line, start_column, id)) as first_name from n where kind in ('class', 'struct', 'interface', 'trait', 'enum', 'namespace') group by file_path, kind")
def e16_symbols_by_file(g: Graph) -> DataFrame:
    """Types of every file by kind, and the first of them; nothing is gathered into one value."""
    rows = g.nodes("kind", "name", "file_path", "start_line", "start_column").filter(F.col("kind").isin("class", "struct", "interface", "trait", "enum", "namespace"))
    return rows.groupBy("file_path", "kind").agg(count().alias("n_symbols"), F.min_by("name", F.struct("start_line", "start_column", "id")).alias("first_name"))


# --- ranking and sets


@query(with_(N) + "select ref_id, id, rk as rank from (select r.ref_id, n.id, row_number() over (partition by r.ref_id order by case when n.file_path = r.file_path then 0 else 1 end, n.file_path, n.start_line, n.start_column, n.id) as rk from refs r join n on n.name = r.reference_name) where rk <= 3")
def f2_same_file_first(g: Graph) -> DataFrame:
    refs = g.raw("refs").select("ref_id", F.col("reference_name").alias("name"), F.col("file_path").alias("from_path"))
    met = refs.join(g.nodes("name", "file_path", "start_line", "start_column"), "name")
    order = [F.when(F.col("file_path") == F.col("from_path"), 0).otherwise(1), "file_path", "start_line", "start_column", "id"]
    return strongest(met, ["ref_id"], order, 3).select("ref_id", "id", "rank")


@query(with_(N, L) + "select node_id, caller_id, rk as rank from (select target as node_id, source as caller_id, row_number() over (partition by target order by source) as rk from (select distinct target, source from l where kind = 'calls')) where rk <= 8")
def f9_topk_per_group(g: Graph) -> DataFrame:
    """The first eight callers of every symbol."""
    calls = g.links("calls").select(F.col("target").alias("node_id"), F.col("source").alias("caller_id")).distinct()
    return strongest(calls, ["node_id"], ["caller_id"], 8).select("node_id", "caller_id", "rank")


@query(with_(N) + "select ref_id, reference_name from refs where language = 'go' or reference_name in (select name from n where kind = 'method') or from_node_id in (select id from n where kind = 'class')")
def g2_union_by_row_id(g: Graph) -> DataFrame:
    """References of three lanes, each row once however many lanes name it."""
    refs, nodes = g.raw("refs").select("ref_id", "reference_name", "language", "from_node_id"), g.nodes("kind", "name")
    a = refs.filter("language = 'go'")
    b = refs.join(nodes.filter("kind = 'method'").select(F.col("name").alias("reference_name")).distinct(), "reference_name", "left_semi")
    c = refs.join(nodes.filter("kind = 'class'").select(F.col("id").alias("from_node_id")), "from_node_id", "left_semi")
    return a.unionByName(b).unionByName(c).select("ref_id", "reference_name").distinct()


_OLD = "old as (select id, arg_min(docstring, updated_at) as d from (select id, coalesce(docstring, '') as docstring, updated_at from nodes where id is not null) group by id)"


@query(with_(N, _OLD) + "select n.id, n.name from n join old on old.id = n.id where old.d <> coalesce(n.docstring, '')")
def g4_changed_symbols(g: Graph) -> DataFrame:
    """Symbols whose documentation differs between their first and their newest sighting."""
    seen = g.raw("nodes").filter("id is not null").withColumn("d", F.coalesce("docstring", F.lit("")))
    ends = seen.groupBy("id").agg(F.min_by("d", "updated_at").alias("a"), F.max_by("d", "updated_at").alias("b"), F.max_by("name", "updated_at").alias("name"))
    return ends.filter("a <> b").select("id", "name")


@query("select distinct path from scans where path is not null and content_hash is not null and path not in (select path from file_texts where path is not null)")
def g5_removed_files(g: Graph) -> DataFrame:
    """Scanned files of which no text is left."""
    return g.raw("scans").filter("path is not null and content_hash is not null").select("path").distinct().join(g.raw("file_texts").filter("path is not null").select("path").distinct(), "path", "left_anti")


# --- functions


@query(with_(N) + "select id, kind || ':' || substr(sha256(file_path || ':' || kind || ':' || name || ':' || start_line), 1, 32) as computed from n where file_path is not null and name is not null and start_line is not null")
def n1_node_id(g: Graph) -> DataFrame:
    rows = g.nodes("kind", "name", "file_path", "start_line").filter("file_path is not null and name is not null and start_line is not null")
    return rows.select("id", node_id(F.col("file_path"), F.col("kind"), F.col("name"), F.col("start_line")).alias("computed"))


@query(with_(FILES) + "select path, regexp_extract(path, '([^/]+)$', 1) as base, regexp_replace(path, '/?[^/]*$', '') as dir, regexp_replace(path, '^([^/]+)/', '\\1/') as norm from f")
def n3_path_parts(g: Graph) -> DataFrame:
    """Parts, and the normal form of the path with a detour through a sibling directory."""
    detour = F.regexp_replace("path", "^([^/]+)/", "./$1/x/../")
    return g.files().select("path", basename(F.col("path")).alias("base"), dirname(F.col("path")).alias("dir"), normalized(detour).alias("norm"))


@query(with_(N) + f"select name, array_to_string(list_filter({_SEG}, lambda x: x <> ''), ' ') as segments from (select distinct name from n where name is not null)")
def s15_segments(g: Graph) -> DataFrame:
    return g.nodes("name").filter("name is not null").select("name").distinct().select("name", F.array_join(segments(F.col("name")), " ").alias("segments"))


@query(with_(N) + """select name, string_split(name, '_')[1] || coalesce(array_to_string(list_transform(list_slice(string_split(name, '_'), 2, 100), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ''), '') as camel from (select distinct name from n where kind = 'function' and name is not null)""")
def n9_snake_to_camel(g: Graph) -> DataFrame:
    return g.nodes("kind", "name").filter("kind = 'function' and name is not null").select("name").distinct().select("name", snake_to_camel(F.col("name")).alias("camel"))


def _stem_sql() -> str:
    # stated rule by rule, as suffix pairs of the word
    cut = lambda k, put="": f"left(w, length(w) - {k}) || '{put}'"
    twice = lambda k: f"substr(w, length(w) - {k}, 1) = substr(w, length(w) - {k + 1}, 1)"
    rules = [
        ("w like '%ing' and length(w) > 5", [cut(3), cut(3, "e")]), (f"w like '%ing' and length(w) > 5 and {twice(3)}", [cut(4)]), ("(w like '%tion' or w like '%sion') and length(w) > 5", [cut(3)]),
        ("w like '%ment' and length(w) > 6", [cut(4)]), ("w like '%ies' and length(w) > 4", [cut(3, "y")]), ("w like '%es' and w not like '%ies' and length(w) > 4", [cut(2)]),
        ("w like '%s' and w not like '%es' and w not like '%ss' and length(w) > 4", [cut(1)]), ("w like '%ed' and w not like '%eed' and length(w) > 4", [cut(1), cut(2)]),
        ("w like '%ied' and length(w) > 5", [cut(3, "y")]), ("w like '%er' and length(w) > 4", [cut(2), cut(2, "e")]), (f"w like '%er' and length(w) > 4 and {twice(2)}", [cut(3)]),
    ]
    parts = ", ".join(f"case when {cond} then {v} end" for cond, values in rules for v in values)
    return f"array_to_string(list_sort(list_distinct(list_filter([{parts}], lambda x: x is not null and length(x) >= 3 and x <> w))), ' ')"


@query(with_(N) + f"select w as word, {_stem_sql()} as stems from (select distinct unnest({_SEG}) as w from n) where w <> ''")
def n7_stems(g: Graph) -> DataFrame:
    words = g.nodes("name").select(F.explode(segments(F.col("name"))).alias("word")).distinct()
    return words.select("word", F.array_join(stems(F.col("word")), " ").alias("stems"))


# --- extraction and frameworks


@query()
def x2_extracted_symbols(g: Graph) -> DataFrame:
    """Symbols extracted anew from the texts, by file and kind."""
    from lodegraph.sources.extract import extract

    return extract(g.raw("file_texts")).filter("what = 'node'").groupBy("file_path", "kind").agg(count().alias("n_symbols"))


@query()
def x4_extracted_references(g: Graph) -> DataFrame:
    from lodegraph.sources.extract import extract

    return extract(g.raw("file_texts")).filter("what = 'ref'").groupBy("reference_name", "reference_kind").agg(count().alias("n_sites"))


@query(with_(FILES) + r"""select path, '/' || regexp_replace(regexp_replace(regexp_extract(path, '(?:^|/)(?:src/)?(?:pages|app)/(.*)\.[^./]+$', 1), '(^|/)(?:index|page)$', ''), '/+$', '') as route
  from f where regexp_matches(path, '(^|/)(src/)?(pages|app)/.*\.[^./]+$')""")
def w2_page_routes(g: Graph) -> DataFrame:
    """Routes of files in page folders."""
    from lodegraph.functions.routes import page_route

    return g.files().select("path", page_route(F.col("path")).alias("route")).filter("route is not null")


@query(with_(N) + "select a.id as command_id, count(*) as n_callers from (select id, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) as w from n where kind = 'function' and language = 'rust') a join (select lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) as w from n where kind = 'function' and language in ('typescript', 'javascript')) b on a.w = b.w where a.w <> '' group by 1")
def w4_wire_names(g: Graph) -> DataFrame:
    """Functions of one language and their namesakes of another, by wire name."""
    from lodegraph.functions.routes import wire_name

    rows = g.nodes("kind", "name", "language").filter("kind = 'function' and name is not null").select("id", "language", wire_name(F.col("name")).alias("w")).filter("w <> ''")
    there = rows.filter(F.col("language").isin("typescript", "javascript")).groupBy("w").agg(count().alias("n_callers"))
    return rows.filter("language = 'rust'").join(there, "w").select(F.col("id").alias("command_id"), "n_callers")


# --- further joins, orders and sets


@query(with_(N) + "select id, name from n where kind in ('function', 'method') and contains(lower(name), 'glyph')")
def d16_infix_callables(g: Graph) -> DataFrame:
    """Callables with a word inside their name."""
    return g.nodes("kind", "name").filter(F.col("kind").isin("function", "method") & F.contains(F.lower("name"), F.lit("glyph"))).select("id", "name")


_WORDS = "w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{3,32}')) as word from documents where text is not null and doc_kind = 'commit')"
_SEGS = f"sg as (select distinct name, unnest({_SEG}) as segment from n where kind in ('function', 'method', 'class'))"


@query(with_(N, _WORDS, _SEGS) + "select name, count(*) as n_words from sg join w on w.word = sg.segment group by name having count(*) >= 2")
def d19_segment_matches(g: Graph) -> DataFrame:
    """Symbols of which at least two segments are words of commit messages."""
    words = g.raw("documents").filter("text is not null and doc_kind = 'commit'").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]{3,32}', 0)")).alias("segment")).distinct()
    names = g.nodes("kind", "name").filter(F.col("kind").isin("function", "method", "class") & F.col("name").isNotNull()).select("name").distinct()
    segs = names.select("name", F.explode(F.array_distinct(segments(F.col("name")))).alias("segment"))
    return segs.join(words, "segment", "left_semi").groupBy("name").agg(count().alias("n_words")).filter("n_words >= 2")


@query(with_(N) + "select distinct name from n where name is not null")
def e5_names(g: Graph) -> DataFrame:
    return g.nodes("name").filter("name is not null").select("name").distinct()


@query(with_(N, L) + "select file_path, n_callers, n_symbols from (select n.file_path, count(distinct n.id) as n_symbols, coalesce(sum(c.k), 0)::bigint as n_callers from n left join (select target, count(distinct source) as k from l where kind = 'calls' group by 1) c on c.target = n.id where n.kind <> 'file' group by 1)")
def e12_file_weights(g: Graph) -> DataFrame:
    """Symbols of every file, and the callers they have."""
    called = g.links("calls").select("source", "target").distinct().groupBy(F.col("target").alias("id")).agg(count().alias("k"))
    rows = g.nodes("kind", "file_path").filter("kind <> 'file'").join(called, "id", "left")
    return rows.groupBy("file_path").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_callers"), count().alias("n_symbols"))


@query(with_(N, FILES) + "select id, name, rk as rank from (select n.id, n.name, row_number() over (partition by n.name order by case when f.generated = 1 then 1 else 0 end, n.file_path, n.start_line, n.start_column, n.id) as rk from n left join f on f.path = n.file_path where n.kind in ('function', 'method') and n.name is not null) where rk <= 5")
def f3_generated_last(g: Graph) -> DataFrame:
    """Definitions of a name, those in generated files last, five each."""
    made = g.files().filter("generated = 1").select(F.col("path").alias("file_path"), F.lit(1).alias("made"))
    rows = g.nodes("kind", "name", "file_path", "start_line", "start_column").filter(F.col("kind").isin("function", "method") & F.col("name").isNotNull()).join(made, "file_path", "left")
    return strongest(rows, ["name"], [F.coalesce("made", F.lit(0)), "file_path", "start_line", "start_column", "id"], 5).select("id", "name", "rank")


@query(with_(N, L) + "select distinct source as id from l where kind = 'calls' and source not in (select source from l where kind = 'references')")
def g6_callers_without_references(g: Graph) -> DataFrame:
    links = g.links("calls", "references")
    calls = links.filter("kind = 'calls'").select(F.col("source").alias("id")).distinct()
    return calls.join(links.filter("kind = 'references'").select(F.col("source").alias("id")).distinct(), "id", "left_anti")


@query(with_(FILES) + "select path from (select path from scans where path is not null union select path from f) where path in (select path from f) or path in (select path from scans where content_hash is not null)")
def t4_sync_candidates(g: Graph) -> DataFrame:
    """Paths a sync has to look at: everything scanned with a hash, and everything indexed."""
    scanned = g.raw("scans").filter("path is not null and content_hash is not null").select("path")
    return scanned.unionByName(g.files().select("path")).distinct()


@query("select distinct regexp_replace(path, '^.*/', '') as base, (select string_agg(upper(left(p, 1)) || substr(p, 2), '' order by k) from (select unnest(string_split(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', ''), '-')) as p, generate_subscripts(string_split(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', ''), '-'), 1) as k)) as component from documents where path is not null")
def n9_kebab_to_pascal(g: Graph) -> DataFrame:
    """Base names of documents as component names."""
    base = basename(F.col("path"))
    return g.raw("documents").filter("path is not null").select(base.alias("base"), kebab_to_pascal(F.regexp_replace(base, r"\.[^.]*$", "")).alias("component")).distinct()


@query("select word, n_docs from (select lower(strip_accents(w)) as word, count(distinct doc_id) as n_docs from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{3,}')) as w from documents where text is not null and doc_id is not null) group by 1)")
def n8_plain_words(g: Graph) -> DataFrame:
    """Words of all texts without marks and case, with the number of documents."""
    words = g.raw("documents").filter("text is not null and doc_id is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{3,}"), F.lit(0))).alias("w"))
    fine = words.groupBy(plain_word(F.col("w")).alias("word"), "doc_id").agg(count())
    return fine.groupBy("word").agg(count().alias("n_docs"))
