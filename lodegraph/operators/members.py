"""Members of types: methods with supertypes, method calls by receiver, factory chains and receiver types from source text.

All joins over (type, method name); supertypes are walked level by level, four at most.  Of several answers the one with
the greatest confidence wins, then the path, line and id.  Nulls name nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.names import segments
from lodegraph.operators.resolve import CEILING
from lodegraph.operators.traversal import levels

TYPES = ("class", "interface", "struct", "trait", "protocol", "enum", "module", "namespace")
#: Levels of supertypes that a member is looked for.
MOST_SUPERTYPES = 4
PLACE = ["file_path", "start_line", "start_column", "id"]


def methods_of_types(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(type_id, type_name, language, name, id, file_path, start_line, start_column): the methods that each type contains."""
    types = nodes.filter(F.col("kind").isin(*TYPES)).select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    methods = nodes.filter("kind = 'method' and name is not null").select("id", "name", "language", "file_path", "start_line", "start_column")
    held = links.filter("kind = 'contains'").select(F.col("source").alias("type_id"), F.col("target").alias("id")).distinct()
    return held.join(types, "type_id").join(methods, "id").select("type_id", "type_name", "language", "name", *PLACE)


def method_table(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(type_id, name, id, depth): the method that each name means on each type: its own, or that of the nearest supertype."""
    own = methods_of_types(nodes, links)
    up = links.filter(F.col("kind").isin("extends", "implements"))
    types = nodes.filter(F.col("kind").isin(*TYPES)).select(F.col("id").alias("seed"))
    reach = levels(up, types.join(up.select(F.col("source").alias("seed")).distinct(), "seed", "left_semi"), MOST_SUPERTYPES).select(F.col("seed").alias("type_id"), F.col("id").alias("at"), "depth")
    reach = reach.unionByName(types.join(reach.select(F.col("type_id").alias("seed")).distinct(), "seed", "left_anti").select(F.col("seed").alias("type_id"), F.col("seed").alias("at"), F.lit(0).alias("depth")))
    met = reach.join(own.drop("type_name", "language").withColumnRenamed("type_id", "at"), "at")
    best = met.groupBy("type_id", "name").agg(F.min_by(F.struct("id", "depth"), F.struct("depth", *PLACE)).alias("b"))
    return best.select("type_id", "name", "b.id", "b.depth")



def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000))


def method_calls(calls: DataFrame, methods: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """(reference_name, language, target, confidence) of calls ``receiver.method``: the receiver names the type 0.85, the type with a
    small first letter 0.8; the language's only method of that name 0.7; a type that shares two words with the receiver 0.65."""
    asked = calls.select("reference_name", "language").filter("reference_name is not null").distinct()
    asked = asked.select("*", F.regexp_extract("reference_name", r"^(.*?)(?:::|\.|:)(\w+)$", 1).alias("receiver"), F.regexp_extract("reference_name", r"(\w+)$", 1).alias("name")).filter("receiver <> ''")
    # A name that more methods of a language bear than the ceiling says nothing, and would be a hot key.
    alone = methods.groupBy("language", "name").agg(F.count(F.lit(1)).alias("n_methods")).filter(F.col("n_methods") <= ceiling)
    met = asked.join(alone, ["language", "name"]).join(methods, ["language", "name"])
    many = F.size(F.array_intersect(segments(F.col("receiver")), segments(F.col("type_name"))))
    grade = (
        F.when(F.col("type_name") == F.col("receiver"), 0.85).when(F.col("type_name") == capitalised(F.col("receiver")), 0.8)
        .when(F.col("n_methods") == 1, 0.7).when(many >= 2, 0.65)
    )
    met = met.withColumn("grade", grade.cast("double")).filter("grade is not null")
    best = met.groupBy("reference_name", "language").agg(F.min_by(F.struct(F.col("id").alias("target"), F.col("grade").alias("confidence")), F.struct((-F.col("grade")).alias("g"), *PLACE)).alias("b"))
    return best.select("reference_name", "language", "b.target", "b.confidence")


def factory_chains(calls: DataFrame, nodes: DataFrame, returns: DataFrame, table: DataFrame) -> DataFrame:
    """(reference_name, language, target, confidence) of calls ``inner().method``: a type that a function ``inner`` of the language returns, and its method.

    ``returns`` is (source, target): function and type; a function that returns ``self`` has its own type there.  ``table`` is ``method_table``.
    """
    shape = r"^(?:.*(?:::|\.))?(\w+)\(\)(?:::|\.)(\w+)$"
    asked = calls.select("reference_name", "language").filter("reference_name is not null").distinct().select("*", F.regexp_extract("reference_name", shape, 1).alias("inner"), F.regexp_extract("reference_name", shape, 2).alias("name")).filter("inner <> ''")
    makers = nodes.filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("source"), F.col("name").alias("inner"), "language")
    made = makers.join(returns.select("source", F.col("target").alias("type_id")).distinct(), "source").select("inner", "language", "type_id").distinct()
    met = asked.join(made, ["inner", "language"]).join(table, ["type_id", "name"])
    best = met.groupBy("reference_name", "language").agg(F.min_by("id", F.struct("depth", "type_id", "id")).alias("target"))
    return best.select("reference_name", "language", "target", F.lit(0.85).alias("confidence"))


#: How source text says what a name is: assigned from a constructor, declared with a type before or behind it.
DECLARED = [r"\b(\w+)\s*(?::=|=)\s*(?:new\s+|&)?([A-Z]\w*)\s*(?:::new|\.new)?\s*[({]", r"\b(\w+)\??\s*:\s*(?:&(?:mut\s+)?)?([A-Za-z_]\w*)", r"\b([A-Z]\w*)(?:<[^<>]*>)?\s+(\w+)\s*[=;,)]"]
RECEIVER_CALL = r"(?:^|[^\w.])([A-Za-z_]\w*)\.([A-Za-z_]\w*)\("


def numbered_lines(texts: DataFrame) -> DataFrame:
    """(path, line, code): the lines of the texts, counted from 1."""
    return texts.filter("path is not null and text is not null").select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("n", "code")).select("path", (F.col("n") + 1).alias("line"), "code")


def receiver_types(texts: DataFrame, scopes: DataFrame) -> DataFrame:
    """(path, line, receiver, method, type_name): for calls ``receiver.method(`` the nearest declaration of the receiver above, not above the enclosing scope.

    ``scopes`` is (path, start_line, end_line) of functions.  Lines meet by path and name; the scope is the innermost around the
    call, the file where there is none.
    """
    lines = numbered_lines(texts)
    pairs = lambda pattern, a, b: F.arrays_zip(F.regexp_extract_all("code", F.lit(pattern), F.lit(a)).alias("a"), F.regexp_extract_all("code", F.lit(pattern), F.lit(b)).alias("b"))
    calls = lines.select("path", "line", F.explode(pairs(RECEIVER_CALL, 1, 2)).alias("c")).select("path", "line", F.col("c.a").alias("receiver"), F.col("c.b").alias("method")).distinct()
    says = [lines.select("path", F.col("line").alias("at"), F.lit(k).alias("form"), F.explode(pairs(p, *((2, 1) if k == 2 else (1, 2)))).alias("d")) for k, p in enumerate(DECLARED)]
    declared = says[0].unionByName(says[1]).unionByName(says[2]).select("path", "at", "form", F.col("d.a").alias("receiver"), F.col("d.b").alias("type_name"))
    around = calls.join(scopes, "path", "left").groupBy("path", "line", "receiver", "method").agg(F.coalesce(F.max(F.when(F.col("line").between(F.col("start_line"), F.col("end_line")), F.col("start_line"))), F.lit(1)).alias("since"))
    met = around.join(declared, ["path", "receiver"]).filter("at <= line and at >= since")
    return met.groupBy("path", "line", "receiver", "method").agg(F.max_by("type_name", F.struct("at", (-F.col("form")).alias("f"), "type_name")).alias("type_name"))
