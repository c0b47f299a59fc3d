"""Reference resolution: a cascade of joins, each strategy taking what the ones before left over.

Strategies give (ref_id, target, confidence, resolved_by); per reference the first that answers with enough
confidence wins, ties by path, line, column and id.  Popular names are bounded by an ambiguity ceiling, which is
part of the semantics: above it a name says nothing.  References that nothing resolves stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import proximity
from lodegraph.plans.settings import NUMBERS, number
from lodegraph.plans.storage import Workspace

# Names that are built in, by language; kinds; families; the ceiling.
BUILT_INS = {
    "javascript": "console window document Math JSON Object Array String Number Boolean Promise Map Set Date RegExp Error Symbol parseInt parseFloat setTimeout setInterval clearTimeout clearInterval require fetch process Buffer".split(),
    "python": "print len range str int float bool list dict set tuple open super isinstance issubclass hasattr getattr setattr type enumerate zip map filter sorted reversed sum min max abs any all next iter repr hash id input vars dir".split(),
    "go": "append cap close complex copy delete imag len make new panic print println real recover error string int bool byte rune fmt os io strings strconv errors context sync time".split(),
    "c": "printf fprintf sprintf snprintf malloc calloc realloc free memcpy memset memmove strlen strcpy strcmp strncmp strcat fopen fclose fread fwrite exit abort assert sizeof".split(),
    "rust": "Some None Ok Err Vec String Box Rc Arc Option Result println print format vec panic assert assert_eq".split(),
    "java": "System String Object Integer Long Double Boolean List Map Set ArrayList HashMap Math Thread Exception".split(),
    "ruby": "puts print require require_relative raise attr_accessor attr_reader attr_writer include extend lambda proc loop".split(),
}
BUILT_INS["typescript"] = BUILT_INS["javascript"]
FAMILIES = {"typescript": "web", "javascript": "web", "tsx": "web", "jsx": "web", "vue": "web", "svelte": "web", "java": "jvm", "kotlin": "jvm", "scala": "jvm", "c": "c", "cpp": "c", "objc": "c", "cuda": "c"}
CALLABLE = ("function", "method", "class", "struct", "component")
CEILING = NUMBERS["ambiguityCeiling"][0]


def family(language: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[language], language)


def built_in(name: Column, language: Column) -> Column:
    out = F.lit(False)
    for lang, names in BUILT_INS.items():
        out = out | ((language == lang) & name.isin(*names))
    return F.coalesce(out, F.lit(False))


def unfiltered(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References that are not built in, or whose name the project defines itself in the same language."""
    defined = nodes.filter(F.col("kind").isin(*CALLABLE)).select(F.col("name").alias("reference_name"), "language").distinct().withColumn("own", F.lit(True))
    met = refs.join(defined, ["reference_name", "language"], "left")
    return met.filter(~built_in(F.col("reference_name"), F.col("language")) | F.col("own")).drop("own")


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, "([^./:]+)$", 1)


def known(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with some segment that names a symbol."""
    names = nodes.select(F.col("name").alias("_key")).filter("_key is not null").distinct()
    keys = refs.select("ref_id", F.explode(F.array_distinct(F.array("reference_name", last_segment(F.col("reference_name")), F.regexp_extract("reference_name", "^([^./:]+)", 1)))).alias("_key"))
    hits = keys.join(names, "_key", "left_semi").select("ref_id").distinct()
    return refs.join(hits, "ref_id", "left_semi")


def candidates(refs: DataFrame, nodes: DataFrame, left_key: Column, right_key: Column, *more: str) -> DataFrame:
    """Pairs on a key, without keys above the ambiguity ceiling; ``n_candidates`` symbols share the key."""
    keyed = nodes.withColumn("_key", right_key).filter("_key is not null and _key <> ''")
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n_candidates")).filter(F.col("n_candidates") <= number(nodes.sparkSession, "ambiguityCeiling"))
    left = refs.select("ref_id", "reference_name", "reference_kind", F.col("file_path").alias("ref_path"), F.col("language").alias("ref_language"), F.col("line").alias("ref_line"), "from_node_id").withColumn("_key", left_key)
    right = keyed.select("_key", F.col("id").alias("target"), F.col("kind").alias("target_kind"), F.col("file_path").alias("target_path"), F.col("language").alias("target_language"), "start_line", "start_column", "is_exported", *more)
    return left.join(sizes, "_key").join(right, "_key")


def first_choice(pairs: DataFrame, score: Column) -> DataFrame:
    """The best pair per reference; ties by path, line, column, id."""
    order = F.struct((-score).alias("s"), "target_path", "start_line", "start_column", "target")
    row = F.struct(*[F.col(c) for c in pairs.columns if c != "ref_id"])
    return pairs.groupBy("ref_id").agg(F.min_by(row, order).alias("_r")).select("ref_id", "_r.*")


def answer(df: DataFrame, confidence: Column, by: str) -> DataFrame:
    return df.select("ref_id", "target", confidence.cast("double").alias("confidence"), F.lit(by).alias("resolved_by"))


def by_file_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path-like names of files: whole path 0.95, a path's end 0.85, a lone base name 0.7."""
    files = nodes.filter("kind = 'file'")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    paths = refs.filter(F.col("reference_name").rlike(r"/|\.[A-Za-z0-9]{1,5}$"))
    pairs = candidates(paths, files, base(F.col("reference_name")), base(F.col("file_path")))
    grade = F.when(F.col("target_path") == F.col("reference_name"), 0.95).when(F.endswith(F.col("target_path"), F.concat(F.lit("/"), F.col("reference_name"))), 0.85).when(F.col("n_candidates") == 1, 0.7)
    pairs = pairs.withColumn("grade", grade).filter("grade is not null")
    return answer(first_choice(pairs, F.col("grade") * 1000 + proximity(F.col("ref_path"), F.col("target_path"))), F.col("grade"), "file-path")


def by_qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Qualified names: unique or in the same file 0.95, an ending 0.85."""
    dotted = refs.filter(F.col("reference_name").rlike(r"::|\.|/"))
    pairs = candidates(dotted, nodes, last_segment(F.col("reference_name")), last_segment(F.col("qualified_name")), "qualified_name")
    same = F.col("qualified_name") == F.col("reference_name")
    pairs = pairs.filter(F.endswith("qualified_name", "reference_name")).withColumn("grade", F.when(same, 0.95).otherwise(0.85))
    return answer(first_choice(pairs, F.col("grade") * 1000 + F.when(F.col("ref_path") == F.col("target_path"), 100).otherwise(0)), F.col("grade"), "qualified-name")


def by_exact_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Same name: one candidate 0.9 (0.5 across languages); of several the best score, 0.7 where it is near, else 0.4."""
    symbols = nodes.filter(~F.col("kind").isin("file", "import"))
    pairs = candidates(refs, symbols, F.col("reference_name"), F.col("name"))
    same_file, same_language = F.col("ref_path") == F.col("target_path"), F.col("ref_language") == F.col("target_language")
    near = proximity(F.col("ref_path"), F.col("target_path"))
    fits = F.when((F.col("reference_kind") == "calls") & F.col("target_kind").isin("function", "method"), 25).when((F.col("reference_kind") == "instantiates") & F.col("target_kind").isin("class", "struct", "interface"), 25).otherwise(0)
    closeness = F.when(same_file & (F.col("ref_line") != 0), F.greatest(F.lit(0.0), 20 - F.abs(F.col("start_line") - F.col("ref_line")) / 10)).otherwise(0.0)
    score = F.when(same_file, 100).otherwise(0) + near + F.when(same_language, 50).otherwise(-80) + fits + F.when(F.col("is_exported") == 1, 10).otherwise(0) + closeness
    pairs = pairs.withColumn("near", near).withColumn("score", F.coalesce(score, F.lit(-100.0))).filter((F.col("n_candidates") == 1) | (F.col("score") > -1))
    grade = F.when(F.col("n_candidates") == 1, F.when(same_language, 0.9).otherwise(0.5)).when(F.col("near") >= 30, 0.7).otherwise(0.4)
    return answer(first_choice(pairs, F.col("score")), grade, "exact-match")


def by_unique_fuzzy_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names equal but for case, callables, unique: 0.5, across languages 0.3."""
    pairs = candidates(refs, nodes.filter(F.col("kind").isin(*CALLABLE)), F.lower("reference_name"), F.lower("name")).filter("n_candidates = 1")
    return answer(pairs, F.when(F.col("ref_language") == F.col("target_language"), 0.5).otherwise(0.3), "fuzzy")


def by_function_reference(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions as values: in the same file 0.95, else a unique one of the family 0.8; never the reference's own function."""
    pairs = candidates(refs.filter("reference_kind = 'function_ref'"), nodes.filter(F.col("kind").isin("function", "method")), F.col("reference_name"), F.col("name"))
    pairs = pairs.filter((family(F.col("ref_language")) == family(F.col("target_language"))) & (F.col("target") != F.col("from_node_id")))
    same = F.col("ref_path") == F.col("target_path")
    grade = F.when(same, 0.95).when(F.col("n_candidates") == 1, 0.8)
    pairs = pairs.withColumn("grade", grade).filter("grade is not null")
    return answer(first_choice(pairs, F.col("grade")), F.col("grade"), "function-ref")


@dataclass
class Project:
    """What a strategy may look at: the symbols always; links, files and texts where the caller has them."""

    nodes: DataFrame
    links: DataFrame | None = None
    files: DataFrame | None = None
    texts: DataFrame | None = None


#: A strategy gives (ref_id, target, confidence, resolved_by) for open references; the order decides between equal confidence.
Strategy = Callable[[DataFrame, Project], DataFrame]
STRATEGIES: list[Strategy] = [lambda refs, project, f=f: f(refs, project.nodes) for f in (by_function_reference, by_file_path, by_qualified_name, by_exact_name, by_unique_fuzzy_name)]


def resolve(refs: DataFrame, nodes: DataFrame, project: Project | None = None, further: Sequence[Strategy] = ()) -> DataFrame:
    """(ref_id, target, confidence, resolved_by) of the references that some strategy resolves.

    ``further`` strategies (of frameworks, say) come before the built-in ones.  All strategies see the same filtered references
    and their answers meet in one aggregation: the order of the strategies and the confidence decide, so nothing depends on
    which finishes first and the plan has one last shuffle.
    """
    project = project or Project(nodes)
    # Read by every strategy: written once each.
    space = Workspace(nodes.sparkSession, "resolve")
    wanted = [c for c in nodes.columns if c in ("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "start_column", "is_exported", "end_line")]
    project.nodes, _ = space.write(nodes.select(*wanted), "nodes")
    open_refs, _ = space.write(known(unfiltered(refs, project.nodes), project.nodes), "open")
    answers = [s(open_refs, project).select("ref_id", "target", "confidence", "resolved_by", F.lit(k).alias("turn")) for k, s in enumerate([*further, *STRATEGIES])]
    every = reduce(DataFrame.unionByName, answers)
    sure = F.when(F.col("confidence") >= 0.9, 0).otherwise(1)
    best = every.groupBy("ref_id").agg(F.min_by(F.struct("target", "confidence", "resolved_by"), F.struct(sure.alias("s"), (-F.col("confidence")).alias("c"), "turn", "target")).alias("b"))
    return best.select("ref_id", "b.*")


def resolved_edges(refs: DataFrame, nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """Edges of the answers: an extends to an interface becomes implements, a call of a type an instantiation; families gate references."""
    kinds = nodes.select("id", F.col("kind").alias("k"), F.col("language").alias("lang"))
    met = answers.join(refs.select("ref_id", "from_node_id", "reference_kind", "line", "col", "language"), "ref_id").join(kinds.withColumnRenamed("id", "target"), "target")
    met = met.filter((F.col("reference_kind") != "references") | (family(F.col("language")) == family(F.col("lang"))))
    kind = F.when((F.col("reference_kind") == "extends") & F.col("k").isin("interface", "protocol"), "implements").when((F.col("reference_kind") == "calls") & F.col("k").isin("class", "struct", "union"), "instantiates").when(F.col("reference_kind") == "function_ref", "references").otherwise(F.col("reference_kind"))
    return met.select("ref_id", F.col("from_node_id").alias("source"), "target", kind.alias("kind"), "line", "col", "confidence", "resolved_by")
