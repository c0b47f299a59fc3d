"""Ranked symbol search: inverted index with BM25, then substring ladder, then edit distance, then rescoring.

A query is a scalar and is parsed on the driver; everything over symbols is DataFrame work.  The index is one row
per (token, node) with the weighted frequency; prefix matching groups the index's tokens that start with a term.
Null names, documentation and signatures count as empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodegraph.functions.names import segments, tokens
from lodegraph.functions.paths import basename, dirname, is_non_production
from lodegraph.plans.storage import Workspace

# Kinds and their bonus, column weights, BM25 parameters.
NODE_KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component union".split()
KIND_BONUS = {
    "function": 10, "method": 10, "interface": 9, "trait": 9, "route": 9, "protocol": 9, "class": 8, "component": 8, "type_alias": 6, "struct": 6, "union": 6, "enum": 5, "module": 4, "namespace": 4,
    "property": 3, "field": 3, "constant": 3, "enum_member": 3, "variable": 2, "import": 1, "export": 1, "parameter": 0, "file": 0,
}
WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
K1, B = 1.2, 0.75
OPERATORS = {"and", "or", "not", "near"}


@dataclass
class ParsedQuery:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def parse_query(raw: str) -> ParsedQuery:
    """Blanks separate, ``"..."`` holds together; ``kind:``, ``lang:``/``language:``, ``path:`` and ``name:`` are filters, anything else is text."""
    out, words = ParsedQuery(), []
    for word in re.findall(r'(?:[^\s"]|"[^"]*"?)+', raw):
        key, colon, value = word.partition(":")
        value = value[1:].removesuffix('"') if value.startswith('"') else value
        if colon and value and key == "kind" and value in NODE_KINDS:
            out.kinds.append(value)
        elif colon and value and key in ("lang", "language"):
            out.languages.append(value.lower())
        elif colon and value and key == "path":
            out.paths.append(value.lower())
        elif colon and value and key == "name":
            out.names.append(value.lower())
        else:
            words.append(word[1:].removesuffix('"') if word.startswith('"') else word)
    out.text = " ".join(words)
    return out


def terms(text: str) -> list[str]:
    """Prefix terms of the index query: ``::`` parts words, quoting signs go, operator words go; the rest as the index tokenizes it."""
    cleaned = re.sub(r"['\"*():^]", "", text.replace("::", " "))
    words = [w for w in cleaned.split() if w.lower() not in OPERATORS]
    return list(dict.fromkeys(t for w in words for t in re.split(r"[^a-z0-9]+", w.lower()) if t))


def filtered(nodes: DataFrame, q: ParsedQuery) -> DataFrame:
    if q.kinds:
        nodes = nodes.filter(F.col("kind").isin(*q.kinds))
    if q.languages:
        nodes = nodes.filter(F.col("language").isin(*q.languages))
    return nodes


def _weighted(words: Column, weight: float) -> Column:
    return F.transform(words, lambda x: F.struct(x.alias("token"), F.lit(weight).alias("w")))


def _columns(nodes: DataFrame) -> DataFrame:
    """(id, length, t_...): the tokens of every indexed column, split once, and their number."""
    split = nodes.select("id", *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t_{c}") for c in WEIGHTS])
    length = F.size("t_id")
    for c in list(WEIGHTS)[1:]:
        length = length + F.size(f"t_{c}")
    return split.withColumn("length", length)


def _postings(split: DataFrame, query_terms: list[str] | None = None) -> DataFrame:
    """(id, token, tf, length) of the tokens that start with a term, or of all; filtered within the arrays, before anything is exploded."""
    wanted = lambda x: sum_or(*[x.startswith(t) for t in query_terms])
    lists = [_weighted(F.filter(f"t_{c}", wanted) if query_terms else F.col(f"t_{c}"), w) for c, w in WEIGHTS.items()]
    rows = split.select("id", "length", F.explode(F.concat(*lists)).alias("t"))
    return rows.groupBy("id", F.col("t.token").alias("token")).agg(F.sum("t.w").alias("tf"), F.max("length").alias("length"))


def postings(nodes: DataFrame) -> DataFrame:
    """(id, token, tf, length): weighted frequency of every token of every symbol, and the symbol's token count."""
    return _postings(_columns(nodes))


def bm25(nodes: DataFrame, query_terms: list[str]) -> DataFrame:
    """(id, score) of the symbols with a token that starts with a term, from the symbols themselves in one pass over them."""
    seen = Observation()
    split = _columns(nodes).observe(seen, F.count(F.when(F.col("length") > 0, 1)).alias("n_all"), F.sum("length").alias("all_tokens"))
    hits, found = Workspace(nodes.sparkSession, "bm25").write(_postings(split, query_terms), "hits")
    if not found["rows"]:  # a plan known to be empty is not run, and then nothing is observed; without hits no total is needed
        return hits.select("id", F.lit(0.0).alias("score"))
    return scored(hits, query_terms, seen.get["n_all"], seen.get["all_tokens"] or 0)


def scored(index: DataFrame, query_terms: list[str], n_all: int, all_tokens: int) -> DataFrame:
    """(id, score) from postings: idf = max(1e-6, ln((N - n + 0.5) / (n + 0.5))), n being the symbols a term meets; lengths count all columns."""
    meets = F.array(*[F.when(F.col("token").startswith(t), F.lit(i)) for i, t in enumerate(query_terms)])
    hits = index.select("id", "tf", "length", F.explode(F.filter(meets, lambda x: x.isNotNull())).alias("term"))
    per = hits.groupBy("term", "id").agg(F.sum("tf").alias("f"), F.max("length").alias("length"))
    met = per.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    graded = per.join(F.broadcast(met), "term")  # one row per term of the query
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(n_all)) - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / (all_tokens / max(1, n_all))))
    return graded.groupBy("id").agg(F.sum(part).alias("score"))


class SearchIndex:
    """Postings as a table that many queries read, by first letter of the token, and its maintenance.

    A query reads the letters its terms start with.  An update replaces the postings of the symbols of changed files: each
    generation holds what is new, and a list of ids that it takes back from the generations before; ``compact`` makes one of all.
    """

    def __init__(self, nodes: DataFrame):
        self.spark, self.space, self.generations = nodes.sparkSession, Workspace(nodes.sparkSession, "index"), 0
        self.parts: list[tuple[DataFrame, DataFrame | None]] = []
        self._add(nodes, None)

    def _add(self, nodes: DataFrame, gone: DataFrame | None) -> None:
        n, self.generations = self.generations, self.generations + 1
        split, _ = self.space.write(_columns(nodes), f"split={n}")
        rows, _ = self.space.write(_postings(split).withColumn("letter", F.substring("token", 1, 1)), f"postings={n}", "letter")
        lengths, _ = self.space.write(split.select("id", "length"), f"lengths={n}")
        if gone is not None:
            gone, _ = self.space.write(gone.select("id").distinct(), f"gone={n}")
        self.parts.append((rows, lengths, gone))

    def _live(self, which: int) -> DataFrame:
        """All generations, each without the ids that later ones take back."""
        out, taken = None, None
        for part in reversed(self.parts):
            rows = part[which] if taken is None else part[which].join(taken, "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
            if part[2] is not None:
                taken = part[2] if taken is None else taken.unionByName(part[2]).distinct()
        return out

    def update(self, old: DataFrame, new: DataFrame) -> None:
        """Takes back the symbols ``old`` (id) and adds ``new``: those of changed or removed files, before and after."""
        self._add(new, old.select("id").unionByName(new.select("id")))

    def compact(self) -> None:
        rows, _ = self.space.write(self._live(0), f"postings=all-{self.generations}", "letter")
        lengths, _ = self.space.write(self._live(1), f"lengths=all-{self.generations}")
        self.parts = [(rows, lengths, None)]

    def postings(self) -> DataFrame:
        return self._live(0).select("id", "token", "tf", "length")

    def bm25(self, query_terms: list[str]) -> DataFrame:
        total = self._live(1).agg(F.count(F.when(F.col("length") > 0, 1)).alias("n"), F.sum("length").alias("t")).first()
        hits = self._live(0).filter(F.col("letter").isin(*sorted({t[:1] for t in query_terms})))
        return scored(hits, query_terms, total["n"], total["t"] or 0)


def like_ladder(nodes: DataFrame, text: str) -> DataFrame:
    """(id, score): 1.0 exact, 0.9 prefix, 0.8 within the name, 0.7 within the qualified name; case does not count."""
    low, name, qualified = F.lit(text.lower()), F.lower("name"), F.lower("qualified_name")
    score = F.when(name == low, 1.0).when(name.startswith(low), 0.9).when(F.contains(name, low), 0.8).when(F.contains(qualified, low), 0.7)
    return nodes.select("id", score.alias("score")).filter("score is not null")


def fuzzy_names(nodes: DataFrame, text: str) -> DataFrame:
    """(id, distance): names within one edit (up to four letters) or two."""
    most = 1 if len(text) <= 4 else 2
    names = nodes.select("name").filter("name is not null").distinct().select("name", F.levenshtein(F.lower("name"), F.lit(text.lower()), most).alias("distance")).filter("distance >= 0")
    return nodes.join(names, "name").select("id", "distance")


def kind_bonus(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv])[kind], F.lit(0)).cast("double")


def name_bonus(name: Column, text: str) -> Column:
    """80 exact, 60 named among several words, 10 to 40 by share for a prefix, 15 for all terms contained, 10 within."""
    packed, words = re.sub(r"\s+", "", text.lower()), text.lower().split()
    low = F.lower(name)
    split = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text))
    parts = [t for t in re.split(r"[\s_.-]+", split.lower()) if t]
    out = F.when(low == packed, 80.0)
    if len(words) > 1:
        out = out.when(low.isin(*words), 60.0)
    out = out.when(low.startswith(packed), F.round(F.lit(10.0) + F.lit(30.0 * len(packed)) / F.length(low)))
    if len(parts) >= 2:
        every = F.lit(True)
        for t in parts:
            every = every & F.contains(low, F.lit(t))
        out = out.when(every, 15.0)
    return out.when(F.contains(low, F.lit(packed)), 10.0).otherwise(0.0)


def path_relevance(path: Column, text: str) -> Column:
    """Per word +10 in the base name, +5 in the directory, else +3 anywhere; -15 for test files unless tests are asked for."""
    out = F.lit(0.0)
    base, directory, low = F.lower(basename(path)), F.lower(dirname(path)), F.lower(path)
    for word in text.lower().split():
        subs = [s for s in re.split(r"[^a-z0-9]+", word) if s]
        within = lambda c: sum_or(*[F.contains(c, F.lit(s)) for s in subs])
        if subs:
            out = out + F.when(within(base), 10.0).otherwise(0.0) + F.when(within(directory), 5.0).when(within(low), 3.0).otherwise(0.0)
    if not re.search("test|spec", text.lower()):
        out = out - F.when(is_non_production(path), 15.0).otherwise(0.0)
    return out


def sum_or(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def search(nodes: DataFrame, raw: str, limit: int = 100, index: SearchIndex | None = None) -> DataFrame:
    """(id, name, kind, score, rank): index hits, else the ladder, else near names; exact names supplemented, all rescored.

    The candidate stages are tried in order on the driver, each by one small action.
    """
    q = parse_query(raw)
    pool = filtered(nodes, q)
    if not q.text:
        base = pool.select("id", F.lit(1.0).alias("score"))
    else:
        # Each stage is written as it is tried: its row count decides, and the later steps read the few hits.
        space, found = Workspace(nodes.sparkSession, "search"), terms(q.text)
        stages = [
            lambda: (index.bm25(found) if index else bm25(nodes, found)).join(pool.select("id"), "id", "left_semi") if found else None,
            lambda: like_ladder(pool, q.text) if len(q.text) >= 2 else None,
            lambda: fuzzy_names(pool, q.text).select("id", (1.0 / (1 + F.col("distance"))).alias("score")),
        ]
        for k, stage in enumerate(stages):
            hits = stage()
            if hits is not None:
                base, seen = space.write(hits, f"stage={k}")
                if seen["rows"]:
                    break
        words = [w.lower() for w in raw.split() if len(w) >= 2]
        named = pool.filter(F.lower("name").isin(*words)).select("id") if words else pool.select("id").limit(0)
        top = base.agg(F.max("score").alias("score")).first()["score"]
        extra = named.join(base, "id", "left_anti").select("id", F.lit(top).alias("score")).filter("score is not null")
        base = base.unionByName(extra)
    text = q.text or raw
    rows = base.join(pool, "id").withColumn("score", F.col("score") + kind_bonus(F.col("kind")) + path_relevance(F.col("file_path"), text) + name_bonus(F.col("name"), text))
    packed = re.sub(r"\s+", "", text.lower())
    exact = F.when(F.lower("name") == packed, 0).otherwise(1)
    ranked = rows.orderBy(exact, F.desc("score"), "id").limit(limit).select("id", "name", "kind", "file_path", F.round("score", 6).alias("score"))
    for wanted, column in ((q.paths, "file_path"), (q.names, "name")):
        if wanted:
            ranked = ranked.filter(sum_or(*[F.contains(F.lower(column), F.lit(w)) for w in wanted]))
    return ranked


def segment_seeds(nodes: DataFrame, token: str, most: int = 3) -> DataFrame:
    """(id, name): callables whose segments hold the token's segments in a row, shortest names first; none if some symbol has that very name."""
    parts = [s for s in re.split(r"[^a-z0-9]+", re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", token)).lower()) if s]
    if len(parts) < 2:
        return nodes.select("id", "name").limit(0)
    callables = nodes.filter(F.col("kind").isin("function", "method"))
    run = F.array(*[F.lit(p) for p in parts])
    joined = lambda a: F.concat(F.lit("\x01"), F.array_join(a, "\x01"), F.lit("\x01"))
    hits = callables.filter((F.lower("name") != token.lower()) & F.contains(joined(segments(F.col("name"))), joined(run)))
    return hits.orderBy(F.length("name"), "name", "file_path", "start_line", "id").limit(most).select("id", "name")


def last_part(symbol: str) -> str:
    """The part of a qualified name behind its last ``::``, dot or slash; '' if there is none."""
    parts = [p for p in re.split(r"::|[./]", symbol) if p]
    return parts[-1] if parts else ""


def matches_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """The nodes that ``symbol`` means: the exact name, a file's base name without extension, or a qualified name of which the last part is
    the node's name while the rest stands in its qualified name or among the segments of its path."""
    parts = [p for p in re.split(r"::|[./]", symbol) if p]
    bare = lambda c: F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")
    fits = (F.col("name") == symbol) | ((F.col("kind") == "file") & (bare(F.col("name")) == symbol))
    if len(parts) >= 2:
        segments_of = F.filter(F.split("file_path", "/"), lambda x: x != "")
        hinted = F.lit(True)
        for hint in parts[:-1]:
            hinted = hinted & (F.array_contains(segments_of, hint) | F.array_contains(F.transform(segments_of, bare), hint))
        fits = fits | ((F.col("name") == parts[-1]) & (F.contains("qualified_name", F.lit("::".join(parts))) | hinted))
    return nodes.filter(F.coalesce(fits, F.lit(False)))


def lookup(nodes: DataFrame, symbol: str, limit: int = 50) -> DataFrame:
    """A search for one symbol: if a qualified name finds nothing, its last part is tried."""
    found = search(nodes, symbol, limit)
    if found.limit(1).count() or last_part(symbol) in ("", symbol):
        return found
    return search(nodes, last_part(symbol), limit)
