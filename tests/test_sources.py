from pyspark.sql import functions as F

from lodegraph.operators.incremental import VersionedState
from lodegraph.operators.resolve import resolve
from lodegraph.sources.extract import extract, without_comments
from lodegraph.sources.project import scan_project
from lodegraph.streaming.changes import SCANS, debounced, process_stream, scan_stream


def test_extraction(spark):
    py = "import os\n\nclass A(Base):\n    @mark\n    def m(self):\n        return os.path()\n\ndef f():\n    m()\n"
    ts = "// class No {\nexport class B extends C {\n  run() { call(1); }\n}\nfunction g() { return 1; }\n"
    texts = spark.createDataFrame([("a.py", py), ("b.ts", ts), ("c.py", "def ("), ("d.xyz", "?"), ("e.py", None), (None, "x")], "path string, text string")
    rows = extract(texts).collect()
    nodes = {(r.file_path, r.kind, r.qualified_name) for r in rows if r.what == "node"}
    assert nodes >= {("a.py", "class", "A"), ("a.py", "method", "A::m"), ("a.py", "function", "f"), ("a.py", "import", "os"), ("b.ts", "class", "B"), ("b.ts", "function", "g"), ("c.py", "file", "c.py"), ("d.xyz", "file", "d.xyz"), ("e.py", "file", "e.py")}
    assert {(r.reference_name, r.reference_kind) for r in rows if r.what == "ref" and r.file_path == "a.py"} == {("Base", "extends"), ("mark", "decorates"), ("os.path", "calls"), ("m", "calls")}
    assert not any(r.name == "No" for r in rows)


def test_comment_stripping_keeps_offsets():
    text = 'x = "# no"  # yes\ny = 1'
    out = without_comments(text, "a.py")
    assert len(out) == len(text) and "yes" not in out and "# no" in out
    assert without_comments("a; /* b\nc */ d // e", "a.c") == "a;     \n     d     "


def test_project_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/big.py").write_text("#" * 3000)
    (tmp_path / "src/readme.txt").write_text("no")
    (tmp_path / "node_modules/b.js").write_text("1")
    rows = {r.path: r for r in scan_project(spark, str(tmp_path), max_bytes=1000).collect()}
    assert set(rows) == {"src/a.py", "src/big.py"} and rows["src/a.py"].text == "x = 1\n" and rows["src/big.py"].text is None and rows["src/big.py"].message


def test_streams_equal_batches(spark, tmp_path):
    rows = [(1, 1, "a", "H1", 1, 1000, 10), (2, 1, "a", "h2", 1, 2500, 20), (3, 1, "a", "h2", 1, 9000, 30), (4, 1, "b", "h3", 1, 1000, 5), (5, 1, None, "h", 1, 1, 1)]
    spark.createDataFrame(rows, SCANS).write.parquet(str(tmp_path / "in"))
    query = debounced(scan_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.path, r.first_seen, r.last_seen, r.n_events) for r in spark.table("bursts").collect()} == {("a", 1000, 2500, 2), ("a", 9000, 9000, 1), ("b", 1000, 1000, 1)}
    state, got = VersionedState(spark, f"file://{tmp_path}/state"), []
    state.start(spark.createDataFrame([("b", "H3", 1)], "key string, hash string, seen_at bigint"))
    process_stream(scan_stream(spark, str(tmp_path / "in")), state, str(tmp_path / "check"), lambda df, epoch: got.extend((r.key, r.case) for r in df.collect())).awaitTermination(120)
    assert got == [("a", "new")] and {(r.key, r.hash) for r in state.read().collect()} == {("a", "h2"), ("b", "h3")}


def test_resolution_cascade(spark):
    nodes = spark.createDataFrame(
        [("n1", "function", "load", "m::load", "src/a.py", "python", 1, 0, 3, 1), ("n2", "function", "load", "k::load", "lib/b.py", "python", 1, 0, 3, 0), ("n3", "class", "Only", "Only", "src/c.py", "python", 1, 0, 9, 1), ("n4", "function", "Unique", "Unique", "x/d.go", "go", 1, 0, 2, 1)],
        "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, start_column int, end_line int, is_exported int",
    )
    refs = spark.createDataFrame(
        [(1, "q", "load", "calls", 5, 0, "src/z.py", "python"), (2, "q", "Only", "instantiates", 5, 0, "src/z.py", "python"), (3, "q", "unique", "calls", 5, 0, "src/z.py", "python"), (4, "q", "print", "calls", 5, 0, "src/z.py", "python"), (5, "q", "nothing", "calls", 5, 0, "src/z.py", "python"), (6, "q", "m::load", "calls", 5, 0, "src/z.py", "python"), (7, "q", None, "calls", 5, 0, "src/z.py", "python")],
        "ref_id bigint, from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, language string",
    )
    got = {r.ref_id: (r.target, r.resolved_by, r.confidence) for r in resolve(refs, nodes).collect()}
    assert got[1][:2] == ("n1", "exact-match") and got[2] == ("n3", "exact-match", 0.9) and got[6] == ("n1", "qualified-name", 0.95)
    assert not {4, 5, 7} & set(got)
