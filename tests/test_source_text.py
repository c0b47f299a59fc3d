from lodegraph.operators import context as C
from lodegraph.operators import search as S
from lodegraph.operators import source_text as X
from lodegraph.operators.resolve import resolve
from lodegraph.operators.traversal import bfs
from lodegraph.plans.settings import number
from lodegraph.sources.extract import EXTRACTORS, extract, node_row, register

TEXT = "path string, text string"


def test_blocks_of_components_and_fences(spark):
    vue = "<template>\n <b/>\n</template>\n<script setup lang=\"ts\">\nlet a = 1 < 2\n</script>\n<script>\nb()\n</script>\n"
    astro = "---\nconst x = 1\n---\n<p/>\n"
    got = {(r.path, r.lang, r.first_line, r.code) for r in X.script_blocks(spark.createDataFrame([("a.vue", vue), ("b.astro", astro), ("c.ts", vue), ("d.svelte", None)], TEXT)).collect()}
    assert got == {("a.vue", "ts", 4, "\nlet a = 1 < 2\n"), ("a.vue", "js", 7, "\nb()\n"), ("b.astro", "ts", 1, "const x = 1")}
    long = "x\n```py\n" + "a = '`'\n" * 20_000 + "```\n\n```\nno name\n```\n\n```js\nopen"
    docs = spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id bigint, text string")
    assert [(r.doc_id, r.lang, len(r.code)) for r in X.fenced_blocks(docs).collect()] == [(1, "py", 160_000)]


def test_framework_files(spark):
    nest = "@Controller('cats')\nexport class A {\n  @Get(':id')\n  async one() {}\n  @Post()\n  @UseGuards(G)\n  add(x) {}\n}\n"
    assert {(r.method, r.route, r.handler) for r in X.nest_routes(spark.createDataFrame([("a.ts", nest), ("b.ts", "x")], TEXT)).collect()} == {("GET", "/cats/:id", "one"), ("POST", "/cats", "add")}
    scene = '[gd_scene]\n[ext_resource type="Script" path="res://s/p.gd" id="1"]\n[node name="N" groups=["g1", "g2"]]\n[connection signal="hit" from="." to="." method="_on_hit"]\n'
    got = {(r.path, r.kind, r.target, r.name) for r in X.scene_references(spark.createDataFrame([("a.tscn", scene), ("project.godot", '[autoload]\nMain="*res://m.gd"\n')], TEXT)).collect()}
    assert got == {("a.tscn", "resource", "s/p.gd", "1"), ("a.tscn", "group", "", "g1"), ("a.tscn", "group", "", "g2"), ("a.tscn", "signal", "_on_hit", "hit"), ("project.godot", "autoload", "m.gd", "Main")}
    paths = ["app/pages/index.vue", "pages/u/[id].vue", "server/api/x.get.ts", "server/routes/r.ts", "middleware/auth.global.ts", "pages/x.ts"]
    assert {r.path: (r.kind, r.route) for r in X.nuxt_routes(spark.createDataFrame([(p,) for p in paths], "path string")).collect()} == {"app/pages/index.vue": ("page", "/"), "pages/u/[id].vue": ("page", "/u/:id"), "server/api/x.get.ts": ("endpoint", "/api/x"), "server/routes/r.ts": ("endpoint", "/r"), "middleware/auth.global.ts": ("middleware", "/auth")}


def test_comments_values_snippets_and_lists(spark):
    text = "# One\n# two.\ndef f(a):\n    return g(f, a)\n\n# far\n\ndef g(x): pass\n"
    nodes = spark.createDataFrame([("1", "function", "f", "a.py", 3), ("2", "function", "g", "a.py", 8), ("3", "class", "f", "b.py", 3)], "id string, kind string, name string, file_path string, start_line int")
    texts = spark.createDataFrame([("a.py", text), (None, text), ("c.py", None)], TEXT)
    assert [(r.id, r.docstring) for r in X.preceding_comments(texts, nodes).collect()] == [("1", "One two.")]
    assert [(r.path, r.name, r.id) for r in X.function_values(texts, nodes).collect()] == [("a.py", "f", "1")]
    assert [(r.at_char, r.line) for r in X.first_places(texts, "return", 3).collect()] == [(text.index("return"), 4)]
    rows = spark.createDataFrame([("a", v) for v in [1, 2, 3, 100]] + [(None, 7)], "k string, v int")
    assert {r.k: (r.n, r.median, r.mad, r.p50, r.p99) for r in X.series_statistics(rows, "k", "v").collect()} == {"a": (4, 2, 1, 2, 100), None: (1, 7, 0, 7, 7)}
    assert sorted(map(tuple, X.replayed(rows).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert [r.path for r in X.prefix_keep(spark.createDataFrame([("a/b",), ("a/c/d",), ("x",)], "path string"), ["a/"], ["a/c/"]).collect()] == ["a/b"]
    assert X.parse_json_rows(['{"a": 1}', " "]) == [{"a": 1}]


NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, start_column int, docstring string, signature string, is_exported int"


def nodes_of(spark, rows):
    return spark.createDataFrame([(i, kind, name, q or name, path, "python", 1, 0, None, None, 0) for i, kind, name, q, path in rows], NODES)


def test_symbol_match_and_lookup(spark):
    nodes = nodes_of(spark, [("1", "method", "run", "Job::run", "a/x.py"), ("2", "method", "run", "run", "lib/job.py"), ("3", "file", "job.py", None, "lib/job.py"), ("4", "method", "run", None, "b.py")])
    match = lambda s: {r.id for r in S.matches_symbol(nodes, s).collect()}
    assert match("run") == {"1", "2", "4"} and match("Job.run") == {"1"} and match("job::run") == {"2"} and match("lib/job/run") == {"2"} and match("job") == {"3"} and match("a.b") == set()
    assert {r.id for r in S.lookup(nodes, "nowhere::run").collect()} == {"1", "2", "4"}


def test_an_updated_index_scores_like_a_new_one(spark):
    before = nodes_of(spark, [(str(i), "function", f"shard_ticket_{i}", None, f"f{i % 3}.py") for i in range(12)])
    after = nodes_of(spark, [(str(i), "function", f"shard_ticket_{i}" if i % 3 else f"ticket_index_{i}", None, f"f{i % 3}.py") for i in range(1, 13)])
    index = S.SearchIndex(before)
    gone, new = before.filter("file_path = 'f0.py'").select("id"), after.filter("file_path = 'f0.py'")
    index.update(gone, new)
    want = {r.id: round(r.score, 9) for r in S.bm25(after, ["ticket", "index"]).collect()}
    assert {r.id: round(r.score, 9) for r in index.bm25(["ticket", "index"]).collect()} == want and len(want) == 12
    index.compact()
    assert {r.id: round(r.score, 9) for r in index.bm25(["ticket", "index"]).collect()} == want
    assert {tuple(r) for r in index.postings().collect()} == {tuple(r) for r in S.postings(after).collect()}
    ids = [r.id for r in S.search(after, "ticket", index=index).collect()]
    assert ids == [r.id for r in S.search(after, "ticket").collect()] and ids


def test_explore_rescues_types_of_signatures(spark):
    nodes = nodes_of(spark, [("s", "function", "load_shard", None, "a.py"), ("t", "class", "Config", None, "far.py"), ("u", "class", "Near", None, "a.py"), ("c", "function", "caller", None, "b.py"), ("w", "class", "LoadShard", None, "load.py")])
    links = spark.createDataFrame([("s", "t", "type_of"), ("s", "u", "type_of"), ("s", "w", "returns"), ("c", "s", "calls")], "source string, target string, kind string")
    seeds = spark.createDataFrame([("s", 1)], "id string, rank int")
    assert {r.id: r.role for r in C.explore(nodes, links, seeds, "load shard").collect()} == {"s": "seed", "c": "near", "t": "rescued"}


def test_bfs_options(spark):
    nodes = spark.createDataFrame([(x, "file" if x == "f" else "class") for x in "abcdefg"], "id string, kind string")
    links = spark.createDataFrame([("a", "b", "calls"), ("a", "c", "contains"), ("a", "f", "contains"), ("f", "g", "calls"), ("d", "a", "calls"), ("c", "e", "extends"), ("a", "a", "calls")], "source string, target string, kind string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    walk = lambda **o: [(r.id, r.depth) for r in sorted(bfs(links, nodes, seeds, 2, **o).collect(), key=lambda r: r["rank"])]
    assert walk() == [("a", 0), ("c", 1), ("f", 1), ("b", 1), ("g", 2), ("e", 2)]
    assert walk(refuse_kinds=["file"]) == [("a", 0), ("c", 1), ("b", 1), ("e", 2)]
    assert walk(direction="both", limit=4) == [("a", 0), ("c", 1), ("f", 1), ("b", 1)] and walk(direction="in") == [("a", 0), ("d", 1)]
    assert walk(edge_kinds=["extends"]) == [("a", 0)]


def test_settings_and_registries(spark):
    spark.conf.set("spark.lodegraph.debounceMillis", "5")
    assert number(spark, "debounceMillis") == 100 and number(spark, "ambiguityCeiling") == 500
    spark.conf.unset("spark.lodegraph.debounceMillis")
    register(".toy", lambda path, text: [node_row(path, "function", w, 1, 1) for w in text.split()])
    try:
        assert {r.name for r in extract(spark.createDataFrame([("x.toy", "one two")], TEXT)).collect()} == {"x.toy", "one", "two"}
    finally:
        del EXTRACTORS["toy"]
    nodes = nodes_of(spark, [("1", "function", "go", None, "a.py"), ("2", "class", "Never", None, "b.py")])
    refs = spark.createDataFrame([(1, "q", "go", "calls", 1, 0, "z.py", "python")], "ref_id bigint, from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, language string")
    mine = lambda refs, project: refs.select("ref_id", project.nodes.filter("name = 'Never'").select("id").limit(1).scalar().alias("target")).selectExpr("ref_id", "target", "0.99D as confidence", "'mine' as resolved_by")
    assert [(r.target, r.resolved_by) for r in resolve(refs, nodes, further=[mine]).collect()] == [("2", "mine")]
