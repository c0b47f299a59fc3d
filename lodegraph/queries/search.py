"""Symbol search over the whole index, with fixed query texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.paths import CAMEL_TEST, NON_PRODUCTION
from lodegraph.operators import search as S
from lodegraph.operators.store import Graph
from lodegraph.queries.sql import N, with_

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


TEXT = "shard ticket index"
LIKE_TEXT, FUZZY_TEXT = "ettick", "tikets"

_TOK = "list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_POST = "post as (select id, token, sum(w) as tf from (" + " union all ".join(f"select id, unnest({_TOK.format(c=c)}) as token, {w} as w from n" for c, w in S.WEIGHTS.items()) + ") group by 1, 2)"
_LEN = "len as (select id, " + " + ".join(f"len({_TOK.format(c=c)})" for c in S.WEIGHTS) + " as length from n)"


def _bm25(found: list[str]) -> str:
    hit = " union all ".join(f"select {i} as term, id, tf from post where starts_with(token, '{t}')" for i, t in enumerate(found))
    return f"""{_POST}, {_LEN}, tot as (select count(*) as n_all, avg(length) as mean_length from len where length > 0), per as (select term, id, sum(tf) as f from ({hit}) group by 1, 2), met as (select term, count(*) as n from per group by 1),
      bm as (select per.id, sum(greatest(1e-6, ln((n_all - n + 0.5) / (n + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean_length))) as score from per join met using (term) join len on len.id = per.id, tot group by per.id)"""


@query(with_(N, _bm25(S.terms(TEXT))) + "select id, round(score, 6) as score from bm")
def s3_bm25(g: Graph) -> DataFrame:
    return S.bm25(g.nodes("name", "qualified_name", "docstring", "signature"), S.terms(TEXT)).select("id", F.round("score", 6).alias("score"))


@query(with_(N, _bm25(S.terms(TEXT))) + "select id, round(score, 6) as score from bm")
def s17_index_update(g: Graph) -> DataFrame:
    """The same scores from an index of the first sightings that was updated by the symbols whose newest sighting differs."""
    columns = ["name", "qualified_name", "docstring", "signature"]
    seen = g.raw("nodes").filter("id is not null")
    first = seen.groupBy("id").agg(F.min_by(F.struct(*columns), "updated_at").alias("x")).select("id", "x.*")
    newest = g.nodes(*columns)
    sides = first.withColumn("side", F.lit(-1)).unionByName(newest.withColumn("side", F.lit(1))).groupBy("id", *columns).agg(F.sum("side").alias("side"))
    changed = sides.filter("side <> 0")
    index = S.SearchIndex(first)
    index.update(changed.select("id"), changed.filter("side > 0").select("id", *columns))
    return index.bm25(S.terms(TEXT)).select("id", F.round("score", 6).alias("score"))


@query(with_(N) + f"select id, score from (select id, case when lower(name) = '{LIKE_TEXT}' then 1.0 when starts_with(lower(name), '{LIKE_TEXT}') then 0.9 when contains(lower(name), '{LIKE_TEXT}') then 0.8 when contains(lower(qualified_name), '{LIKE_TEXT}') then 0.7 end::double as score from n) where score is not null")
def s4_like_ladder(g: Graph) -> DataFrame:
    return S.like_ladder(g.nodes("name", "qualified_name"), LIKE_TEXT)


@query(with_(N) + f"select id, levenshtein(lower(name), '{FUZZY_TEXT}') as distance from n where name is not null and levenshtein(lower(name), '{FUZZY_TEXT}') <= 2")
def s5_fuzzy(g: Graph) -> DataFrame:
    return S.fuzzy_names(g.nodes("name"), FUZZY_TEXT)


@query(with_(N) + "select term, id from (select term, n.id, row_number() over (partition by term order by n.id) as rk from (select distinct lower(reference_name) as term from refs) q join n on lower(n.name) = term) where rk <= 20")
def s6_exact_supplement(g: Graph) -> DataFrame:
    """Exact names without case for every referenced name, twenty each."""
    from lodegraph.operators.adjacency import strongest

    asked = g.raw("refs").filter("reference_name is not null").select(F.lower("reference_name").alias("term")).distinct()
    met = asked.join(g.nodes("name").withColumn("term", F.lower("name")), "term")
    return strongest(met, ["term"], ["id"], 20).select("term", "id")


@query(with_(N) + r"""select id, name from (select *, row_number() over (order by length(name), name, file_path, start_line, id) as rk from n where kind in ('function', 'method') and lower(name) <> 'ticket_batch'
  and contains('|' || regexp_replace(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+', '|', 'g') || '|', '|ticket|batch|')) where rk <= 3""")
def s7_segment_seed(g: Graph) -> DataFrame:
    return S.segment_seeds(g.nodes("kind", "name", "file_path", "start_line"), "ticket_batch")


@query(with_(N) + "select id, name from (select id, name, row_number() over (order by name, id) as rk from n where kind = 'class' and language = 'python') where rk <= 500")
def s8_filter_only(g: Graph) -> DataFrame:
    """No text: the filters' symbols by name, one page of five times a hundred."""
    q = S.parse_query("kind:class lang:Python")
    return S.filtered(g.nodes("kind", "name", "language"), q).orderBy("name", "id").limit(500).select("id", "name")


def _score_sql(text: str) -> str:
    low = re.sub(r"\s+", "", text.lower())
    kinds = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in S.KIND_BONUS.items()) + " else 0 end"
    words = ", ".join(f"'{w}'" for w in text.lower().split())
    parts = [t for t in re.split(r"[\s_.-]+", text.lower()) if t]
    every = " and ".join(f"contains(lower(name), '{t}')" for t in parts)
    name = f"case when lower(name) = '{low}' then 80 when lower(name) in ({words}) then 60 when starts_with(lower(name), '{low}') then round(10 + 30.0 * {len(low)} / length(name)) when {every} then 15 when contains(lower(name), '{low}') then 10 else 0 end"
    base, folder = "lower(regexp_extract(file_path, '([^/]+)$', 1))", "lower(regexp_replace(file_path, '/?[^/]*$', ''))"
    path = " + ".join(f"case when contains({base}, '{w}') then 10 else 0 end + case when contains({folder}, '{w}') then 5 when contains(lower(file_path), '{w}') then 3 else 0 end" for w in text.lower().split())
    damp = f"case when regexp_matches(file_path, '{NON_PRODUCTION}') or regexp_matches(file_path, '{CAMEL_TEST}') then 15 else 0 end"
    return f"{kinds} + {name} + {path} - {damp}"


@query(with_(N, _bm25(S.terms(TEXT))) + f"""select id, name, kind, file_path, score from (select *, row_number() over (order by case when lower(name) = '{TEXT.replace(' ', '')}' then 0 else 1 end, raw desc, id) as rk from (
   select n.id, name, kind, file_path, round(bm.score + {_score_sql(TEXT)}, 6) as score, bm.score + {_score_sql(TEXT)} as raw from (select id, score from bm union all
     select id, (select max(score) from bm) from n where lower(name) in ({", ".join(f"'{w}'" for w in TEXT.split())}) and id not in (select id from bm)) bm join n on n.id = bm.id)) where rk <= 100""")
def s9_search_ranked(g: Graph) -> DataFrame:
    """The whole pipeline for one query: index, supplement, rescoring, order, limit."""
    return S.search(g.nodes("kind", "name", "qualified_name", "file_path", "language", "docstring", "signature"), TEXT, 100)


@query(with_(N) + f"select id, cast({_score_sql(TEXT)} as double) as bonus from n where file_path is not null and name is not null")
def s12_path_relevance(g: Graph) -> DataFrame:
    """Kind, name and path bonus of every symbol for one query."""
    rows = g.nodes("kind", "name", "file_path").filter("file_path is not null and name is not null")
    return rows.select("id", (S.kind_bonus(F.col("kind")) + S.path_relevance(F.col("file_path"), TEXT) + S.name_bonus(F.col("name"), TEXT)).alias("bonus"))


@query(r"select token, count(*) as n_documents from (select distinct doc_id, unnest(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)) as token from documents where text is not null) group by 1")
def m12_code_tokens(g: Graph) -> DataFrame:
    """Identifiers in code spans of texts, with the number of documents that name them."""
    found = F.expr(r"regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)")
    rows = g.raw("documents").filter("text is not null").select("doc_id", F.explode(found).alias("token")).distinct()
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n_documents"))


_FORMS = {"getattr": r"getattr\([^,()]+,\s*[A-Za-z_]", "computed_call": r"\w+\[[A-Za-z_]\w*\]\(", "emit": r"\.(emit|dispatch|publish|trigger)\(", "reflect": r"\b(Class\.forName|Reflect\.\w+|reflect\.\w+)\(", "send": r"\.(send|public_send|__send__)\("}


@query(" union all ".join(f"select '{k}' as form, path, cast(len(regexp_extract_all(text, '{v}')) as bigint) as n_sites from file_texts where regexp_matches(text, '{v}')" for k, v in _FORMS.items()))
def m13_dispatch_sites(g: Graph) -> DataFrame:
    """Call sites whose target is chosen at run time, by form and file."""
    texts = g.raw("file_texts")
    out = None
    counts = F.array(*[F.struct(F.lit(k).alias("form"), F.size(F.regexp_extract_all("text", F.lit(v), F.lit(0))).cast("bigint").alias("n_sites")) for k, v in _FORMS.items()])
    out = texts.filter("text is not null").select("path", F.explode(counts).alias("c"))
    return out.select("c.form", "path", "c.n_sites").filter("n_sites > 0")
