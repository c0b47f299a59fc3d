"""Questions to source text and to lists of rows that need no graph: comments, snippets, blocks, audits, statistics, replays."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.paths import extension
from lodegraph.operators.members import numbered_lines
from lodegraph.plans.storage import Workspace

COMMENT = r"^\s*(?:///?!?|#+|\*+/?|/\*+|--+)\s?(.*?)\s*(?:\*+/)?$"
FUNCTION_ARGUMENT = r"[(,]\s*([A-Za-z_]\w*)\s*(?:[,)])"
FENCE = "(?m)^```"
# Single characters repeat lazily: a repeated group would nest a frame per character.
SCRIPT = r"(?i)<script\b([^>]*)>([\s\S]*?)</script>"


def prefix_keep(paths: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows whose ``path`` starts with a prefix to include (any, if none is given) and with none to leave out."""
    keep = F.lit(not include)
    for p in include:
        keep = keep | F.col("path").startswith(p)
    for p in exclude:
        keep = keep & ~F.col("path").startswith(p)
    return paths.filter(keep)


def dynamically_named(nodes: DataFrame, refs: DataFrame, languages: list[str]) -> DataFrame:
    """(id, name): symbols that unresolved references of ``languages`` name from another language."""
    asked = refs.filter(F.col("language").isin(*languages)).select(F.col("reference_name").alias("name"), F.col("language").alias("from_language")).distinct()
    met = nodes.filter(~F.col("kind").isin("file", "import")).select("id", "name", "language").join(asked, "name")
    return met.filter("language <> from_language").select("id", "name").distinct()


def series_statistics(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, mad, p50, p99) of whole numbers: the least value with at least that share of rows at or below it."""
    disc = lambda share, column: F.expr(f"cast(percentile_disc({share}) within group (order by {column}) as int)")
    middle = rows.groupBy(F.col(by).alias("_by")).agg(disc(0.5, value).alias("median"))
    apart = rows.join(middle, F.col(by).eqNullSafe(F.col("_by"))).select(by, F.col(value).alias("_v"), "median", F.abs(F.col(value) - F.col("median")).alias("_d"))
    return apart.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.first("median").alias("median"), disc(0.5, "_d").alias("mad"), disc(0.5, "_v").alias("p50"), disc(0.99, "_v").alias("p99"))


def replayed(rows: DataFrame) -> DataFrame:
    """``rows`` written as lines of JSON into the shared folder and read back with their own schema."""
    space = Workspace(rows.sparkSession, "spill")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(space.path("rows"))
    return rows.sparkSession.read.schema(rows.schema).json(space.path("rows"))


def first_places(texts: DataFrame, word: str, around: int) -> DataFrame:
    """(path, at_char, line, snippet): the first place of ``word``: its offset from 0, its line from 1, and ``around`` characters on either side."""
    at = F.instr("text", word)
    before = F.substring(F.col("text"), F.lit(1), F.col("p") - 1)
    found = texts.filter("path is not null").withColumn("p", at).filter("p > 0")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    snippet = F.trim(F.replace(F.substring(F.col("text"), F.greatest(F.lit(1), F.col("p") - around), F.lit(2 * around + len(word))), F.lit("\n"), F.lit(" ")))
    return found.select("path", (F.col("p") - 1).cast("bigint").alias("at_char"), line.cast("bigint").alias("line"), snippet.alias("snippet"))


def function_values(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, name, id): functions of a file whose bare name stands among the arguments of some call in it."""
    words = texts.filter("path is not null and text is not null").select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FUNCTION_ARGUMENT), F.lit(1)))).alias("name"))
    own = nodes.filter(F.col("kind").isin("function", "method")).select("id", "name", F.col("file_path").alias("path"))
    return words.join(own, ["path", "name"]).select("path", "name", "id")


def preceding_comments(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, docstring): the block of comment lines that ends right before a symbol's first line, without its markers."""
    said = numbered_lines(texts).filter(F.col("code").rlike(COMMENT)).select("path", "line", F.regexp_extract("code", COMMENT, 1).alias("said"))
    block = said.withColumn("block", F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line")))
    whole = block.groupBy("path", "block").agg(F.max("line").alias("last_line"), F.array_sort(F.collect_list(F.struct("line", "said"))).alias("l"))
    docs = whole.select(F.col("path").alias("file_path"), (F.col("last_line") + 1).alias("start_line"), F.trim(F.array_join(F.transform("l", lambda x: x["said"]), " ")).alias("docstring"))
    return nodes.join(docs.filter("docstring <> ''"), ["file_path", "start_line"]).select("id", "docstring")


def fenced_blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, code): fenced code blocks that name their language."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    rows = documents.filter("text is not null").select("doc_id", F.split(text, FENCE).alias("parts"))
    # Fences open and close in turn: every second part is a block, the last one only if it is closed.
    each = rows.select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part")).filter("k % 2 = 1 and k < n - 1")
    named = each.withColumn("lang", F.lower(F.regexp_extract("part", r"^(\w+)", 1))).filter("lang <> ''")
    return named.select("doc_id", "lang", F.regexp_replace("part", r"^[^\n]*\n?", "").alias("code"))


def script_blocks(texts: DataFrame) -> DataFrame:
    """(path, lang, first_line, code): script blocks of single-file components (Vue, Svelte, Astro's frontmatter) with the line in the file on which the code starts."""
    rows = texts.filter("path is not null and text is not null")
    parts = rows.filter(extension(F.col("path")).isin("vue", "svelte", "astro", "html")).select("path", "text", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(1)).alias("mark"), F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(2)).alias("code"), F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(0)).alias("whole"))).alias("k", "b"))
    # The k-th block starts where the text before it ends: the texts between blocks are what a split by blocks leaves.
    between = F.split("text", SCRIPT)
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    all_blocks = F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(0))
    above = F.concat(F.array_join(F.transform(F.slice(between, 1, F.col("k") + 1), lambda x: x), ""), F.array_join(F.slice(all_blocks, 1, F.col("k")), ""))
    lang = F.coalesce(F.nullif(F.regexp_extract("b.mark", r"lang=[\"']?(\w+)", 1), F.lit("")), F.lit("js"))
    scripts = parts.select("path", lang.alias("lang"), (lines(above) + 1).alias("first_line"), F.col("b.code").alias("code"))
    front = rows.filter(extension(F.col("path")) == "astro").select("path", F.lit("ts").alias("lang"), F.lit(1).alias("first_line"), F.regexp_extract("text", r"\A---\n([\s\S]*?)\n---", 1).alias("code")).filter("code <> ''")
    return scripts.unionByName(front)


def nest_routes(texts: DataFrame) -> DataFrame:
    """(path, method, route, handler): routes of decorated controllers, the controller's prefix before the method's own path."""
    rows = texts.filter(F.col("path").rlike(r"\.(ts|js)$") & F.col("text").rlike(r"@Controller\("))
    prefix = F.regexp_extract("text", r"@Controller\(\s*(?:\{[^}]*path:\s*)?['\"`]?([^'\"`)}]*)", 1)
    form = r"@(Get|Post|Put|Patch|Delete|Options|Head|All)\(\s*['\"`]?([^'\"`)]*)['\"`]?\s*\)(?:\s*@\w+\([^)]*\))*\s*(?:public\s+|async\s+)*(\w+)\s*\("
    found = lambda g: F.regexp_extract_all("text", F.lit(form), F.lit(g))
    each = rows.select("path", prefix.alias("prefix"), F.explode(F.arrays_zip(found(1).alias("m"), found(2).alias("r"), found(3).alias("h"))).alias("x"))
    route = F.regexp_replace(F.concat(F.lit("/"), F.concat_ws("/", "prefix", "x.r")), "/+", "/")
    return each.select("path", F.upper("x.m").alias("method"), F.when(route == "/", route).otherwise(F.regexp_replace(route, "/$", "")).alias("route"), F.col("x.h").alias("handler"))


def scene_references(texts: DataFrame) -> DataFrame:
    """(path, kind, target, name): what Godot scenes, resources and project files refer to: external resources, autoloads, connected signals and groups."""
    rows = texts.filter(F.col("path").rlike(r"\.(tscn|tres|godot)$") & F.col("text").isNotNull())

    def each(pattern: str, kind: str, target: int, name: int) -> DataFrame:
        take = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
        return rows.select("path", F.explode(F.arrays_zip(take(target).alias("t"), take(name).alias("n"))).alias("x")).select("path", F.lit(kind).alias("kind"), F.regexp_replace("x.t", "^res://", "").alias("target"), F.col("x.n").alias("name"))

    out = each(r'(?m)^\[ext_resource[^\]]*path="([^"]+)"[^\]]*?id="?([^"\s\]]+)', "resource", 1, 2)
    out = out.unionByName(each(r'(?m)^(\w+)="\*?(res://[^"]+)"', "autoload", 2, 1).filter("path like '%.godot'"))
    out = out.unionByName(each(r'(?m)^\[connection signal="([^"]+)"[^\]]*method="([^"]+)"', "signal", 2, 1))
    groups = rows.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"groups=\[([^\]]*)\]"), F.lit(1))).alias("g")).select("path", F.explode(F.regexp_extract_all("g", F.lit(r'"([^"]+)"'), F.lit(1))).alias("n"))
    return out.unionByName(groups.select("path", F.lit("group").alias("kind"), F.lit("").alias("target"), F.col("n").alias("name"))).distinct()


def nuxt_routes(paths: DataFrame) -> DataFrame:
    """(path, kind, route): pages, server endpoints and middleware of a Nuxt project, by their place."""
    page, server, between = (F.regexp_extract("path", p, 1) for p in (r"(?:^|/)pages/(.+)\.vue$", r"(?:^|/)server/((?:api|routes)/.+)\.(?:ts|js)$", r"(?:^|/)middleware/(.+)\.(?:ts|js)$"))
    kind = F.when(page != "", "page").when(server != "", "endpoint").when(between != "", "middleware")
    raw = F.when(page != "", page).when(server != "", F.regexp_replace(F.regexp_replace(server, "^routes/", ""), r"\.(get|post|put|patch|delete)$", "")).otherwise(between)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\[\.\.\.(\w+)\]", "*$1"), r"\[(\w+)\]", ":$1"), "(^|/)index$", "")
    return paths.select("path", kind.alias("kind"), F.concat(F.lit("/"), F.regexp_replace(clean, r"\.global$", "")).alias("route")).filter("kind is not null")


def parse_json_rows(lines: list[str]) -> list[dict]:
    """Objects of lines of JSON, for small results on the driver; blank lines are none."""
    return [json.loads(x) for x in lines if re.search(r"\S", x)]
