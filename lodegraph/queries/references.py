"""Imports and members: where specifiers lead, what imported names, receivers, chains and inherited members mean.

The tables hold no references with receivers or specifiers, so the questions are made from edges: each edge is written as
source text would name its target, and the operators must find the target again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.paths import dirname, extension, shared_directories
from lodegraph.operators import imports as I
from lodegraph.operators import members as M
from lodegraph.operators.adjacency import file_dependencies
from lodegraph.operators.store import Graph
from lodegraph.queries.graph import sparse_dependencies
from lodegraph.queries.resolution import _nodes
from lodegraph.queries.sql import DEPS, L, N, with_
from lodegraph.queries.tables import _SEG, _SHARED

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


# --- imports

_TEXT = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"


def _mapping_sql() -> str:
    parts = []
    for exts, pattern, members, source, imported in I.FORMS.values():
        quoted = pattern.replace("'", "''")
        every = lambda g, q=quoted: f"regexp_extract_all({_TEXT}, '{q}', {g})"
        named = f"list_transform(list_zip({every(2)}, {every(3)}), lambda x: case when length(x[1]) > 0 then x[1] else x[2] end)" if exts == "rs" else every(members)
        found = f"select path, unnest({named}) as names, unnest({every(source)}) as source from file_texts where path is not null and text is not null and {_EXT} in ({', '.join(repr(e) for e in exts.split())})"
        if imported is None:
            pair = "string_split_regex(regexp_replace(trim(member), '^type\\s+', ''), '\\s+as\\s+')"
            parts.append(f"select path, trim({pair}[-1]) as local, trim({pair}[1]) as imported, source from (select path, source, unnest(string_split(names, ',')) as member from ({found})) where trim(member) <> ''")
        else:
            last = "regexp_extract(names, '([^./:]+?)(?:\\.\\w+)?$', 1)" if imported == "*" and "ts" not in exts.split() else "names"
            parts.append(f"select path, {last}, '{imported}', source from ({found})")
    return "select distinct path, local, imported, source from (" + " union all ".join(parts) + ")"


@query(_mapping_sql())
def r16_import_mappings(g: Graph) -> DataFrame:
    """What every file binds by its imports, read from its text."""
    return I.import_mappings(g.raw("file_texts"))


def _specifier(path, target):
    """``target`` as a file at ``path`` would import it: relative, without extension."""
    n = shared_directories(path, target)
    up = F.size(F.split(dirname(path), "/")) - n
    rest = F.array_join(F.slice(F.split(F.regexp_replace(target, r"\.[^./]+$", ""), "/"), n + 1, 100), "/")
    return F.concat(F.when(up == 0, "./").otherwise(F.repeat(F.lit("../"), up)), rest)


_TAILS = "[" + ", ".join(f"'{t}'" for t in [*I.PROBES, *I.INDEXES]) + "]"


@query(with_(N, L, DEPS, "paths as (select distinct path as target from files where path is not null)", f"pairs as (select path, depends_on, regexp_replace(depends_on, '\\.[^./]+$', '') as stem, ['', '.' || {_EXT}] || {_TAILS} as tails from deps where split_part(path, '/', 1) = split_part(depends_on, '/', 1))")
       + """select path, depends_on, target from (select p.path, p.depends_on, f.target, row_number() over (partition by p.path, p.depends_on order by p.k) as rk
         from (select path, depends_on, stem, unnest(tails) as tail, generate_subscripts(tails, 1) as k from pairs) p join paths f on f.target = p.stem || p.tail where f.target <> p.path) where rk = 1""")  # fmt: skip
def r15_import_path(g: Graph) -> DataFrame:
    """Every dependency within a repository, written as a relative specifier without extension, and the file it leads to."""
    deps = file_dependencies(g.links(), g.nodes("file_path")).filter(F.substring_index("path", "/", 1) == F.substring_index("depends_on", "/", 1))
    asked = deps.withColumn("source", _specifier(F.col("path"), F.col("depends_on")))
    found = I.resolve_specifiers(asked, g.files().select("path"))
    return asked.join(found, ["path", "source"]).select("path", "depends_on", "target")


_CROSS = """cross_calls as (select distinct s.file_path as path, t.name, t.file_path as target_path from l join n s on s.id = l.source join n t on t.id = l.target
   where l.kind in ('calls', 'references', 'instantiates') and s.file_path <> t.file_path and t.name is not null and t.kind not in ('file', 'import'))"""


@query(with_(N, L, _CROSS) + """select path, name, target, cast(0.9 as double) as confidence from (select c.path, c.name, n.id as target, row_number() over (partition by c.path, c.name order by coalesce(n.is_exported, 0) desc, n.file_path, n.start_line, n.start_column, n.id) as rk
   from cross_calls c join n on n.file_path = c.target_path and n.name = c.name and n.kind not in ('file', 'import')) where rk = 1""")
def r13_imported_symbol(g: Graph) -> DataFrame:
    """Names used from other files, as if imported from there, and the symbols they mean."""
    nodes = _nodes(g)
    links = g.links("calls", "references", "instantiates")
    ends = nodes.filter(~F.col("kind").isin("file", "import") & F.col("name").isNotNull()).select(F.col("id").alias("target"), "name", F.col("file_path").alias("target_path"))
    used = links.join(ends, "target").join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("path")), "source").filter("path <> target_path").select("path", "name", "target_path").distinct()
    bindings = used.select("path", F.col("name").alias("local"), F.col("name").alias("imported"), "target_path")
    refs = used.select("path", "name").distinct().select(F.struct("path", "name").alias("ref_id"), F.col("path").alias("file_path"), F.col("name").alias("reference_name"))
    return I.imported_symbols(refs, bindings, nodes).select("ref_id.path", "ref_id.name", "target", F.col("confidence").cast("double"))


@query(with_(N, L, "asked as (select distinct s.file_path as a, t.qualified_name from l join n s on s.id = l.source join n t on t.id = l.target where l.kind <> 'contains' and t.language = 'java' and t.kind not in ('file', 'import') and s.file_path is not null and t.qualified_name is not null)")
       + f"""select a as path, qualified_name, id as target from (select *, row_number() over (partition by a, qualified_name order by near desc, b, id) as rk from (
         select a, asked.qualified_name, n.id, n.file_path as b, {_SHARED.replace('(select count', '(select count')} as near from (select a, qualified_name as q, qualified_name from asked) asked join (select id, qualified_name, file_path, file_path as b, language, kind from n) n on n.qualified_name = asked.q and n.language in ('java', 'kotlin', 'scala') and n.kind not in ('file', 'import'))) where rk = 1""")  # fmt: skip
def r14_jvm_import(g: Graph) -> DataFrame:
    """Java symbols used by a file, as if imported by their full names."""
    nodes = g.nodes("kind", "qualified_name", "file_path", "language")
    java = nodes.filter("language = 'java' and kind not in ('file', 'import') and qualified_name is not null").select(F.col("id").alias("target"), "qualified_name")
    used = g.links().filter("kind <> 'contains'").join(java, "target").join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("path")), "source").filter("path is not null").select("path", "qualified_name").distinct()
    asked = used.select(F.struct("path", "qualified_name").alias("import_id"), "path", F.regexp_replace("qualified_name", "::", ".").alias("name"))
    return I.jvm_imports(asked, nodes).select("import_id.path", "import_id.qualified_name", "target")


_TYPE_KINDS = "('class', 'interface', 'struct', 'enum', 'trait')"


@query(with_(N, L, f"ex as (select file_path as path, name, min(id) as id from n where kind in {_TYPE_KINDS} and name is not null group by 1, 2)",
             "p as (select distinct s.file_path as source, t.file_path as target from l join n s on s.id = l.source join n t on t.id = l.target where l.kind in ('extends', 'implements', 'overrides', 'decorates') and s.file_path <> t.file_path)",
             f"r(path, at_path, hops) as (select path, path, 0 from (select source as path from p union select path from ex) union select r.path, p.target, r.hops + 1 from r join p on p.source = r.at_path where r.hops < {I.MOST_REEXPORTS})", recursive=True)
       + "select path, name, id, hops from (select r.path, ex.name, ex.id, r.hops, row_number() over (partition by r.path, ex.name order by r.hops, ex.id) as rk from r join ex on ex.path = r.at_path) where rk = 1")
def h20_reexports(g: Graph) -> DataFrame:
    """Types that each file offers if it re-exports all of the files whose types it inherits from."""
    types = g.nodes("kind", "name", "file_path").filter(F.col("kind").isin("class", "interface", "struct", "enum", "trait") & F.col("name").isNotNull())
    exports = types.groupBy(F.col("file_path").alias("path"), "name").agg(F.min("id").alias("id"))
    wild = sparse_dependencies(g).select(F.col("source").alias("path"), F.col("target").alias("target_path"))
    none = wild.select("path", F.lit("").alias("name"), F.lit("").alias("imported"), "target_path").limit(0)
    return I.exported_through(exports, none, wild)


# --- members

_TYPES = "(" + ", ".join(f"'{t}'" for t in M.TYPES) + ")"
_METHODS = f"m as (select distinct l.source as type_id, t.name as type_name, c.language, c.name, c.id, c.file_path, c.start_line, c.start_column from l join n t on t.id = l.source and t.kind in {_TYPES} join n c on c.id = l.target and c.kind = 'method' where l.kind = 'contains' and c.name is not null)"
_TABLE = f"""up as (select source, target from l where kind in ('extends', 'implements')),
  ar(type_id, at_id, depth) as (select id, id, 0 from n where kind in {_TYPES} union select ar.type_id, up.target, ar.depth + 1 from ar join up on up.source = ar.at_id where ar.depth < {M.MOST_SUPERTYPES}),
  mt as (select type_id, name, id, depth from (select ar.type_id, m.name, m.id, ar.depth, row_number() over (partition by ar.type_id, m.name order by ar.depth, m.file_path, m.start_line, m.start_column, m.id) as rk from ar join m on m.type_id = ar.at_id) where rk = 1)"""


def _table(g: Graph) -> DataFrame:
    return M.method_table(_nodes(g), g.links("contains", "extends", "implements"))


@query(with_(N, L, _METHODS, _TABLE, recursive=True) + "select type_id, name, id, depth from mt")
def r9_method_on_type(g: Graph) -> DataFrame:
    """Every method name on every type: its own, or that of the nearest supertype."""
    return _table(g)


@query(with_(N, L, _METHODS, _TABLE, recursive=True) + "select o.id as method_id, mt.name as member, mt.id as target from m o join mt on mt.type_id = o.type_id where mt.depth > 0")
def r20_inherited_members(g: Graph) -> DataFrame:
    """The deferred pass over ``this.member``: members that a method's own type has from a supertype."""
    own = M.methods_of_types(_nodes(g), g.links("contains")).select("type_id", F.col("id").alias("method_id"))
    return own.join(_table(g).filter("depth > 0"), "type_id").select("method_id", F.col("name").alias("member"), F.col("id").alias("target"))


_CALLED = "called as (select distinct s.language, m.type_name as t, m.name from l join n s on s.id = l.source join m on m.id = l.target where l.kind = 'calls' and s.language is not null)"
_FORMS = "asked as (select distinct language, unnest([t || '.' || name, lower(left(t, 1)) || substr(t, 2) || '.' || name, 'it.' || name, lower(left(t, 1)) || substr(t, 2) || 'Ref.' || name]) as reference_name from called)"


@query(with_(N, L, _METHODS, _CALLED, _FORMS, "alone as (select language, name, count(*) as c from m group by 1, 2)",
             f"met as (select a.reference_name, a.language, m.*exclude(language, name), alone.c, regexp_extract(a.reference_name, '^(.*?)\\.(\\w+)$', 1) as receiver from asked a join m on m.language = a.language and m.name = regexp_extract(a.reference_name, '(\\w+)$', 1) join alone on alone.language = m.language and alone.name = m.name where alone.c <= {M.CEILING})",
             f"graded as (select *, cast(case when type_name = receiver then 0.85 when type_name = upper(left(receiver, 1)) || substr(receiver, 2) then 0.8 when c = 1 then 0.7 when len(list_intersect(list_filter({_SEG.replace('name', 'receiver')}, lambda x: x <> ''), list_filter({_SEG.replace('name', 'type_name')}, lambda x: x <> ''))) >= 2 then 0.65 end as double) as confidence from met)")
       + "select reference_name, language, id as target, confidence from (select *, row_number() over (partition by reference_name, language order by confidence desc, file_path, start_line, start_column, id) as rk from graded where confidence is not null) where rk = 1")
def r7_method_calls(g: Graph) -> DataFrame:
    """Method calls written with the type, with a variable named after it, with a neutral one, and with one that shares its words."""
    methods = M.methods_of_types(_nodes(g), g.links("contains"))
    callers = g.nodes("language").select(F.col("id").alias("source"), F.col("language").alias("caller_language"))
    called = g.links("calls").withColumnRenamed("target", "id").join(methods.select("id", "type_name", "name"), "id").join(callers, "source").filter("caller_language is not null").select(F.col("caller_language").alias("language"), F.col("type_name").alias("t"), "name").distinct()
    small = F.concat(F.lower(F.substring("t", 1, 1)), F.expr("substring(t, 2)"))
    forms = [F.concat(r, F.lit("."), "name") for r in (F.col("t"), small, F.lit("it"), F.concat(small, F.lit("Ref")))]
    return M.method_calls(called.select("language", F.explode(F.array(*forms)).alias("reference_name")), methods)


_MADE = "made as (select distinct f.name as inner_name, f.language, l.target as type_id from l join n f on f.id = l.source and f.kind in ('function', 'method') where l.kind = 'returns' and f.name is not null and f.language is not null)"


@query(with_(N, L, _METHODS, _TABLE, _MADE, "asked as (select distinct inner_name, language, mt.name from made join mt using (type_id))", recursive=True)
       + """select a.inner_name || '()' || case when a.language = 'rust' then '::' else '.' end || a.name as reference_name, a.language, target, cast(0.85 as double) as confidence from (
         select a.inner_name, a.language, a.name, mt.id as target, row_number() over (partition by a.inner_name, a.language, a.name order by mt.depth, made.type_id, mt.id) as rk
         from asked a join made on made.inner_name = a.inner_name and made.language = a.language join mt on mt.type_id = made.type_id and mt.name = a.name) a where rk = 1""")  # fmt: skip
def r5_factory_chains(g: Graph) -> DataFrame:
    """Chains ``factory().method`` (Rust ``factory()::method``) for every function that returns a type and every method it has."""
    nodes, table = _nodes(g), _table(g)
    returns = g.links("returns")
    makers = nodes.filter("kind in ('function', 'method') and name is not null and language is not null").select(F.col("id").alias("source"), F.col("name").alias("inner"), "language")
    asked = makers.join(returns.select("source", F.col("target").alias("type_id")), "source").join(table.select("type_id", "name"), "type_id").select("language", F.concat("inner", F.when(F.col("language") == "rust", "()::").otherwise("()."), "name").alias("reference_name")).distinct()
    out = M.factory_chains(asked, nodes, returns, table)
    return out.withColumn("confidence", F.col("confidence").cast("double"))


def _receiver_sql() -> str:
    lines = "lines as (select path, unnest(parts) as code, generate_subscripts(parts, 1) as line from (select path, string_split_regex(text, '\\r\\n|\\n|\\r') as parts from file_texts where path is not null and text is not null))"
    both = lambda p, a, b: f"unnest(regexp_extract_all(code, '{p}', {a})) as a, unnest(regexp_extract_all(code, '{p}', {b})) as b"
    says = " union all ".join(f"select path, line as at_line, {k} as form, {'b as receiver, a as type_name' if k == 2 else 'a as receiver, b as type_name'} from (select path, line, {both(p, 1, 2)} from lines)" for k, p in enumerate(M.DECLARED))
    return with_(N, lines, f"calls as (select distinct path, line, a as receiver, b as method from (select path, line, {both(M.RECEIVER_CALL, 1, 2)} from lines))", f"says as ({says})",
                 "around as (select c.path, c.line, c.receiver, c.method, coalesce(max(s.start_line), 1) as since from calls c left join n s on s.file_path = c.path and s.kind in ('function', 'method') and c.line between s.start_line and s.end_line group by 1, 2, 3, 4)") + """
      select path, line, receiver, method, type_name from (select a.path, a.line, a.receiver, a.method, s.type_name, row_number() over (partition by a.path, a.line, a.receiver, a.method order by s.at_line desc, s.form, s.type_name desc) as rk
      from around a join says s on s.path = a.path and s.receiver = a.receiver where s.at_line <= a.line and s.at_line >= a.since) where rk = 1"""  # fmt: skip


@query(_receiver_sql())
def r8_receiver_types(g: Graph) -> DataFrame:
    """The type that source text gives the receiver of each method call, by the nearest declaration within the enclosing function."""
    scopes = g.nodes("kind", "file_path", "start_line", "end_line").filter(F.col("kind").isin("function", "method")).select(F.col("file_path").alias("path"), "start_line", "end_line")
    return M.receiver_types(g.raw("file_texts"), scopes)
