"""Imports: what a file binds to which name, where a specifier leads, and which symbol an imported name is.

All joins: bindings come from regular expressions in the JVM, a specifier becomes a few candidate paths with
priorities that meet the files by path, the least priority winning; an imported name meets the exported symbols of
the file it leads to.  Re-exports are followed level by level, a bounded number of times.

Nulls: rows without path, specifier or name bind and resolve nothing.  Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import directories, dirname, extension, normalized, shared_directories
from lodegraph.plans.storage import Workspace

# How languages write imports.  (extensions, pattern, group of the members or the local name, group of the source, what is imported)
_QUOTE = r"""['"]([^'"\n]+)['"]"""
FORMS = {
    "js_named": ("ts tsx js jsx mjs cjs mts cts", r"(?m)^\s*import\s+(?:type\s+)?\{([^}]*)\}\s*from\s*" + _QUOTE, 1, 2, None),
    "js_default": ("ts tsx js jsx mjs cjs mts cts", r"(?m)^\s*import\s+([A-Za-z_$][\w$]*)\s+from\s*" + _QUOTE, 1, 2, "default"),
    "js_namespace": ("ts tsx js jsx mjs cjs mts cts", r"(?m)^\s*import\s+\*\s+as\s+([A-Za-z_$][\w$]*)\s+from\s*" + _QUOTE, 1, 2, "*"),
    "js_require": ("ts tsx js jsx mjs cjs mts cts", r"(?m)^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*require\(\s*" + _QUOTE, 1, 2, "default"),
    "python_from": ("py pyi", r"(?m)^\s*from\s+([\w.]+)\s+import\s+([\w*][\w*, \t]*)", 2, 1, None),
    "python_module": ("py pyi", r"(?m)^\s*import\s+([\w.]+)(?:[ \t]+as[ \t]+\w+)?", 1, 1, "*"),
    "go": ("go", r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", 1, 1, "*"),
    "java": ("java kt", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\.([A-Za-z_]\w*|\*)\s*;?", 2, 1, None),
    "rust": ("rs", r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)::(?:\{([^}]*)\}|(\w+|\*))", 2, 1, None),
    "ruby": ("rb", r"(?m)^\s*require(?:_relative)?\s+" + _QUOTE, 1, 1, "*"),
    "c": ("c h cc cpp hpp cxx", r"(?m)^\s*#\s*include\s+[\"<]([^\">\n]+)[\">]", 1, 1, "*"),
}
#: Extensions tried on a specifier, in this order; the importing file's own come first.
PROBES = [".ts", ".tsx", ".d.ts", ".mts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi", ".go", ".rs", ".java", ".kt", ".rb", ".h", ".hpp", ".c", ".cpp"]
INDEXES = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py", "/mod.rs"]
#: Prefixes that stand for a project's source folder where no configuration says so.
FALLBACKS = {"@/": "src/", "~/": "src/", "@@/": "", "~~/": ""}
JVM = ("java", "kotlin", "scala")
MOST_REEXPORTS = 8


def import_mappings(texts: DataFrame) -> DataFrame:
    """(path, local, imported, source): one row per name a file binds by an import; ``imported`` is '*' for a whole module, 'default' for its default."""
    parts = []
    texts = texts.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    for exts, pattern, members, source, imported in FORMS.values():
        rows = texts.filter(F.col("path").isNotNull() & F.col("text").isNotNull() & extension(F.col("path")).isin(*exts.split()))
        every = lambda g, p=pattern: F.regexp_extract_all("text", F.lit(p), F.lit(g))
        named = every(members) if "rust" not in exts and exts != "rs" else F.zip_with(every(2), every(3), lambda a, b: F.when(F.length(a) > 0, a).otherwise(b))
        found = rows.select("path", F.explode(F.arrays_zip(named.alias("names"), every(source).alias("source"))).alias("i")).select("path", F.col("i.names").alias("names"), F.col("i.source").alias("source"))
        if imported is None:
            one = found.select("path", "source", F.explode(F.split("names", ",")).alias("member")).withColumn("member", F.trim("member")).filter("member <> ''")
            pair = F.split(F.regexp_replace("member", r"^type\s+", ""), r"\s+as\s+")
            parts.append(one.select("path", F.trim(F.element_at(pair, -1)).alias("local"), F.trim(pair[0]).alias("imported"), "source"))
        else:
            last = F.regexp_extract("names", r"([^./:]+?)(?:\.\w+)?$", 1) if imported == "*" and "ts" not in exts.split() else F.col("names")
            parts.append(found.select("path", last.alias("local"), F.lit(imported).alias("imported"), "source"))
    return reduce(DataFrame.unionByName, parts).distinct()


def project_aliases(texts: DataFrame) -> DataFrame:
    """(directory, prefix, target, priority): path aliases of tsconfig and jsconfig files, members of npm workspaces, and go.mod modules.

    ``prefix`` is what specifiers start with, ``target`` the folder it stands for, from the project's root.
    """
    config = texts.filter(F.col("path").rlike(r"(^|/)(ts|js)config[\w.]*\.json$") & F.col("text").isNotNull())
    bare = F.regexp_replace(F.regexp_replace("text", r"(?m)^\s*//[^\n]*|/\*[\s\S]*?\*/", ""), r",(\s*[}\]])", "$1")
    parsed = config.select(dirname(F.col("path")).alias("directory"), F.from_json(bare, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>").alias("c"))
    base = F.coalesce(F.col("c.compilerOptions.baseUrl"), F.lit("."))
    paths = parsed.select("directory", base.alias("base"), F.explode("c.compilerOptions.paths").alias("key", "targets")).select("directory", "base", "key", F.posexplode("targets").alias("priority", "target"))
    where = lambda c: normalized(F.concat_ws("/", "directory", "base", c))
    slash = lambda c: F.regexp_replace(c, r"\*$", "")
    end = F.when(F.col("target").endswith("*"), F.lit("/")).otherwise(F.lit(""))
    aliases = paths.select("directory", slash("key").alias("prefix"), F.concat(where(slash("target")), end).alias("target"), F.col("priority").cast("int").alias("priority"))
    packages = texts.filter(F.col("path").rlike(r"(^|/)package\.json$") & F.col("text").isNotNull())
    names = packages.select(dirname(F.col("path")).alias("folder"), F.get_json_object("text", "$.name").alias("prefix")).filter("prefix is not null and folder <> ''")
    roots = packages.filter(F.get_json_object("text", "$.workspaces").isNotNull()).select(dirname(F.col("path")).alias("directory"))
    members = names.join(roots, (F.col("directory") == "") | F.startswith("folder", F.concat("directory", F.lit("/")))).select("directory", "prefix", F.col("folder").alias("target"), F.lit(0).alias("priority"))
    modules = texts.filter(F.col("path").rlike(r"(^|/)go\.mod$") & F.col("text").isNotNull()).select(dirname(F.col("path")).alias("directory"), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("prefix"))
    modules = modules.filter("prefix <> ''").select("directory", "prefix", F.col("directory").alias("target"), F.lit(0).alias("priority"))
    return aliases.unionByName(members).unionByName(modules)


def resolve_specifiers(requests: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(path, source, target): the file of ``files`` (path) that each (path, source) leads to.

    Order: relative to the importing file; aliases of the nearest configuration; fallback prefixes from the repository's
    root; the importing folder and the root themselves (includes, absolute modules).  Of one place the exact path comes
    before the importing file's own extension, the other extensions and index files.  Unresolved requests are left out.
    """
    asked = requests.select("path", "source").filter("path is not null and source is not null").distinct()
    root = F.substring_index("path", "/", 1)
    dotted = F.when(F.col("source").rlike(r"^\.+[A-Za-z_]"), F.concat(F.expr("repeat('../', length(regexp_extract(source, '^(\\\\.+)', 1)) - 1)"), F.translate(F.regexp_replace("source", r"^\.+", ""), ".", "/")))
    plain = F.when(F.col("source").rlike(r"^[A-Za-z_][\w]*(\.[A-Za-z_]\w*)+$") & extension(F.col("path")).isin("py", "pyi", "java", "kt"), F.translate("source", ".", "/")).when(F.col("source").contains("::"), F.regexp_replace(F.regexp_replace("source", "^(crate|self|super)::", ""), "::", "/")).otherwise(F.col("source"))
    relative = F.when(F.col("source").startswith("."), F.concat_ws("/", dirname(F.col("path")), F.coalesce(dotted, F.col("source"))))
    bases = [(0, relative)]
    for n, (prefix, folder) in enumerate(FALLBACKS.items()):
        bases.append((40 + n, F.when(F.col("source").startswith(prefix), F.concat(root, F.lit("/" + folder), F.expr(f"substring(source, {len(prefix) + 1})")))))
    outside = ~F.col("source").startswith(".")
    bases += [(50, F.when(outside, F.concat_ws("/", dirname(F.col("path")), plain))), (51, F.when(outside, F.concat(root, F.lit("/"), plain))), (52, F.when(outside, F.concat(root, F.lit("/src/"), plain)))]
    places = asked.select("path", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("p"), b.alias("base")) for k, b in bases])).alias("b")).filter("b.base is not null").select("path", "source", "b.p", "b.base")
    if aliases is not None:
        # Every beginning of a specifier that ends at a slash or before one, and every folder above the file, are keys.
        cuts = F.filter(F.sequence(F.lit(1), F.length("source")), lambda k: (F.expr("substring(source, 1, 1)") == "") | F.substring(F.col("source"), k, F.lit(1)).isin("/") | F.substring(F.col("source"), k + 1, F.lit(1)).isin("/", ""))
        keyed = asked.select("path", "source", F.explode(F.transform(cuts, lambda k: F.substring(F.col("source"), F.lit(1), k))).alias("prefix")).select("*", F.explode(directories(F.col("path"))).alias("directory"))
        hit = keyed.join(aliases, ["directory", "prefix"])
        rest = F.expr("substring(source, length(prefix) + 1)")
        places = places.unionByName(hit.select("path", "source", (F.lit(30) - F.size(F.split("directory", "/"))).alias("p"), F.concat("target", rest).alias("base")))
    own = F.concat(F.lit("."), extension(F.col("path")))
    tails = F.concat(F.array(F.lit(""), own), F.array(*[F.lit(x) for x in [*PROBES, *INDEXES]]))
    tried = places.select("path", "source", "p", normalized(F.col("base")).alias("base"), F.posexplode(tails).alias("q", "tail")).select("path", "source", F.struct("p", "q").alias("order"), F.concat("base", "tail").alias("target"))
    met = tried.join(files.select(F.col("path").alias("target")).distinct(), "target").filter("target <> path")
    return met.groupBy("path", "source").agg(F.min_by("target", F.struct("order", "target")).alias("target"))


def imported_symbols(refs: DataFrame, bindings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target, confidence, resolved_by): references whose name, or first segment, a file's import binds to a symbol of the imported file.

    ``bindings`` is (path, local, imported, target_path).  ``a.b`` with an imported ``a`` means the member ``b`` of the symbol or module ``a``.
    Exported symbols come first, then line, column, id.
    """
    parts = F.split("reference_name", r"::|\.")
    asked = refs.filter("reference_name is not null").select("ref_id", F.col("file_path").alias("path"), parts[0].alias("local"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("member"))
    bound = asked.join(bindings, ["path", "local"])
    wanted = F.when(F.col("member").isNotNull(), F.col("member")).when(F.col("imported").isin("*", "default"), F.col("local")).otherwise(F.col("imported"))
    bound = bound.select("ref_id", F.col("target_path").alias("file_path"), wanted.alias("name"))
    symbols = nodes.filter(~F.col("kind").isin("file", "import")).select("id", "name", "file_path", "is_exported", "start_line", "start_column")
    met = bound.join(symbols, ["file_path", "name"])
    best = met.groupBy("ref_id").agg(F.min_by("id", F.struct((-F.coalesce("is_exported", F.lit(0))).alias("e"), "file_path", "start_line", "start_column", "id")).alias("target"))
    return best.select("ref_id", "target", F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))


def jvm_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(import_id, target, confidence): fully qualified names of JVM languages, ``pkg.Sym`` as ``pkg::Sym``; of several the one with most directories in common."""
    asked = imports.select("import_id", "path", F.regexp_replace("name", r"\.", "::").alias("qualified_name"))
    symbols = nodes.filter(F.col("language").isin(*JVM) & ~F.col("kind").isin("file", "import")).select("id", "qualified_name", "file_path")
    met = asked.join(symbols, "qualified_name").withColumn("near", shared_directories(F.col("path"), F.col("file_path")))
    return met.groupBy("import_id").agg(F.min_by("id", F.struct((-F.col("near")).alias("n"), "file_path", "id")).alias("target")).select("import_id", "target", F.lit(0.95).alias("confidence"))


def exported_through(exports: DataFrame, named: DataFrame, wildcards: DataFrame, most: int = MOST_REEXPORTS) -> DataFrame:
    """(path, name, id, hops): what each file offers by its own exports and through at most ``most`` re-exports.

    ``exports`` is (path, name, id); ``named`` (path, name, imported, target_path); ``wildcards`` (path, target_path).  A file's own
    symbol hides re-exported ones, a named re-export hides wildcards, fewer hops hide more; ties by id.
    """
    space = Workspace(exports.sparkSession, "reexports")
    seen, state = space.write(exports.select("path", "name", "id", F.lit(0).alias("hops")).distinct(), "hop=0")
    fresh, n = seen, 0
    while state["rows"] and n < most:
        n += 1
        offered = fresh.select(F.col("path").alias("target_path"), F.col("name").alias("imported"), "id")
        by_name = named.join(offered, ["target_path", "imported"]).select("path", "name", "id", F.lit(0).alias("wild"))
        by_star = wildcards.join(offered, "target_path").select("path", F.col("imported").alias("name"), "id", F.lit(1).alias("wild"))
        step = by_name.unionByName(by_star).groupBy("path", "name").agg(F.min_by("id", F.struct("wild", "id")).alias("id"))
        fresh, state = space.write(step.join(seen.select("path", "name"), ["path", "name"], "left_anti").select("path", "name", "id", F.lit(n).alias("hops")), f"hop={n}")
        seen = seen.unionByName(fresh)
    return seen
