import random

import __spark_entry__ as entry
from test_graph import bfs


def tables(spark, folder, edges):
    """A project of six files with two symbols each, of which the first was changed last."""
    nodes = [(f"n{i}", "function", f"f{i // 2}_test.py" if i // 2 == 5 else f"f{i // 2}.py", 1) for i in range(12)]
    spark.createDataFrame(nodes, "id string, kind string, file_path string, updated_at bigint").write.parquet(f"{folder}/nodes.parquet")
    rows = [(k, a, b, kind, 1, k, None) for k, (a, b, kind) in enumerate(edges)]
    spark.createDataFrame(rows, "id bigint, source string, target string, kind string, line int, col int, metadata string").write.parquet(f"{folder}/edges.parquet")
    files = [(p, "x", "python", 1, 10**12 if p == "f0.py" else 1, 1, 1, None, 0) for p in sorted({n[2] for n in nodes})]
    spark.createDataFrame(files, "path string, content_hash string, language string, size bigint, modified_at bigint, indexed_at bigint, node_count int, errors array<string>, generated int").write.parquet(f"{folder}/files.parquet")
    return {n[0]: n[2] for n in nodes}


def test_file_graph_of_all_kinds(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["calls", "references", "imports", "instantiates", "extends", "contains"]
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(kinds)) for _ in range(14)] + [("n2", "n0", "calls"), ("n10", "n2", "imports"), ("n8", "n10", "calls")]
    where = tables(spark, str(tmp_path), edges)
    pairs = {(where[a], where[b]) for a, b, kind in edges if kind != "contains" and where[a] != where[b]}
    queries = entry.queries()
    cyclic = {a for a, b in pairs if a in bfs(pairs, b)}
    assert {r.path for r in queries["h12_cyclic_files"](spark, str(tmp_path)).collect()} == cyclic and cyclic
    # what depends on the changed file; tests are not expanded
    back = [(b, a) for a, b in pairs if b != "f5_test.py"]
    want = set(bfs(back, "f0.py"))
    got = {r.path: r.is_test for r in queries["h15_affected_tests"](spark, str(tmp_path)).collect()}
    assert got == {p: p == "f5_test.py" for p in want} and "f5_test.py" in want


def test_questions_for_every_symbol(spark, tmp_path):
    # a chain of twelve: far more than five symbols are called
    edges = [(f"n{i}", f"n{i + 1}", "calls") for i in range(11)]
    where = tables(spark, str(tmp_path), edges)
    ask = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    back = [(b, a) for a, b, _ in edges]
    assert {(r.seed, r.id): r.depth for r in ask("h3_callers_depth2")} == {(s, i): d for s in where for i, d in bfs(back, s, 2).items()}
    assert {(r.seed, r.role, r.id) for r in ask("h5_call_graph")} == {(s, "focal", s) for s in where} | {(b, "caller", a) for a, b, _ in edges} | {(a, "callee", b) for a, b, _ in edges}
    assert {r.seed: (r.n_callers, r.n_test_callers, r.n_files) for r in ask("h16_blast_radius")} == {b: (1, int(where[a] == "f5_test.py"), 1) for a, b, _ in edges}
    assert {(r.seed, r.file_path) for r in ask("m5_explore_files")} == {(s, where[s]) for s in where} | {(s, where[x]) for a, b, _ in edges for s, x in ((a, b), (b, a))}
