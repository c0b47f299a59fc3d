import random
import re

import pytest
from pyspark.sql import functions as F

from lodegraph.llm.handwritten import attribute_regex, attribute_rules, banner, by_hand, declared, directories, evidence, foreign_head, literal_data, mined_patterns, minified, not_handwritten, path_patterns, patterns_in_use

MINIFIED = "!function(e,t){" + "".join(f'e["k{i}"]=!1;var v{i}=a=>a.b||{i};' for i in range(40)) + "}(1,2);"
DATA = "VALUES = [\n" + "    0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08,\n" * 20 + "]\n"
HAND = "import x\n\n# Loads it.\ndef load(path):\n    table = [1, 2, 3]\n    return table\n" * 5


@pytest.mark.parametrize("head", ["// Code generated by x. DO NOT EDIT.", "# @generated from a.schema", "/* Generated by x; do not modify. */", "# 此文件由工具自动生成，请勿手动修改", "// Fichier produit par x, ne pas modifier", "// Diese Datei wurde automatisch erzeugt. Nicht bearbeiten!",
                                  "// AUTOGENERATED - changes will be lost on the next build", "# x: regenerate with `make y`, never edit by hand", "// Machine-made from a.idl, edit that instead.", "# Output of x. Hand edits are overwritten.", "/**\n * This file was automatically created by x.\n */"])
def test_banners(head):
    assert banner(f"// my-repo\n//\n{head}\n\ncode();\n")
    assert banner(f"package a\n\nimport b\n\n{head}\n\ncode();\n") and banner("// a line of a licence\n" * 900 + f"{head}\n\ncode();\n")
    assert not banner(f"code();\n\n{head}\nmore();\n")


@pytest.mark.parametrize("head", ['const banner = "// This file was generated automatically";', "// Not generated: edit freely, then run the checks.", "// Written by hand; the generated twin lives in the build directory.", '// writes the line "Code generated by x. DO NOT EDIT." at the top', "// Auto-generated method stub", "// Created by wizard", "/// Generated stub", ""])
def test_no_banners(head):
    assert not banner(f"{head}\n\ncode();\n")


def test_text_evidence():
    assert minified("a/b.js", MINIFIED) and not minified("a/b.js", HAND * 20) and not minified("a/b.py", MINIFIED)
    assert literal_data(DATA) and not literal_data(HAND * 10)
    assert foreign_head("repo/a.py", "# Copyright (c) 2019 The other7 contributors\n") == "other7"
    assert foreign_head("repo/a.py", "# Copyright (c) 2019 the repo authors\n") is None
    assert foreign_head("repo/a.js", "// lib9: upstream release 2.5, imported without changes\n") == "lib9" and foreign_head("repo/a.js", "// lib9 2.5 | licensed under MIT\n") == "lib9"
    assert by_hand("// Written by hand.\nx;\n") and not by_hand("x;\n// written by hand\n") and evidence("r/a.js", "// Not generated.\nx;\n") == "by hand"
    assert evidence(None, "x") is None and evidence("r/a.py", None) is None and evidence("r/a.py", "") is None and evidence("r/a.py", "x" * 300_000) is None


GLOBS = {
    "*.js": (["a.js", "d/e/a.js"], ["a.jsx", "a.js/b"]),
    "third_party/**": (["third_party/a.js", "third_party/a/b.js"], ["x/third_party/a.js", "third_party"]),
    "**/*.js": (["c.js", "a/b/c.js"], ["a/b/c.py"]),
    "a/**/b.c": (["a/b.c", "a/x/b.c", "a/x/y/b.c"], ["b.c", "x/a/b.c", "a/xb.c"]),
    "/gen.py": (["gen.py"], ["a/gen.py"]),
    "lib/*.js": (["lib/a.js"], ["lib/b/a.js", "x/lib/a.js"]),
    "gen?.[jt]s": (["gen1.js", "x/gen2.ts"], ["gen.js", "gen1.cs"]),
    "[!a]x.c": (["bx.c"], ["ax.c"]),
    "a\\*b": (["a*b"], ["axb"]),
    "**/gen/**": (["gen/a", "x/gen/a/b"], ["agen/a", "gen"]),
    "a.b+c": (["a.b+c"], ["axb+c", "a.bbc"]),
    "doc/": ([], ["doc", "doc/a"]),
}


@pytest.mark.parametrize("glob", GLOBS)
def test_globs(glob):
    regex = attribute_regex(glob)
    for path in GLOBS[glob][0]:
        assert re.search(regex, path), path
    for path in GLOBS[glob][1]:
        assert regex is None or not re.search(regex, path), path


def told(spark, files, paths):
    """What the attribute files say of each path, through the join."""
    rules = [r for directory, text in files for r in attribute_rules(directory, text)]
    schema = "directory string, line int, place int, regex string, mark string, is_set boolean"
    got = {r.path: r.said for r in declared(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(rules, schema)).collect()}
    return [got.get(p) for p in paths]


def test_attribute_precedence(spark):
    root = ("r", "# c\n*.js linguist-generated=true\nlib/** linguist-vendored\nlib/keep.js -linguist-vendored -linguist-generated\n*.py linguist-generated=false\n")
    deep = ("r/lib", "keep.js linguist-generated\n")
    paths = ["r/a.js", "r/lib/x.c", "r/lib/d/e/x.c", "r/lib/keep.js", "r/a.py", "r/a.c", "q/a.js"]
    assert told(spark, [root], paths) == [True, True, True, False, False, None, None]
    assert told(spark, [root, deep], paths) == [True, True, True, True, False, None, None]
    # unspecified takes earlier rules back, mark by mark; the deeper file wins over a later line of the upper one
    assert told(spark, [("r", "*.js linguist-generated linguist-vendored\nkeep/** !linguist-generated\n")], ["r/keep/a.js", "r/x.js"]) == [True, True]
    assert told(spark, [("r", "*.js linguist-generated\nkeep/** !linguist-generated\n")], ["r/keep/a.js", "r/keep/b/c.js", "r/x.js"]) == [None, None, True]
    assert told(spark, [("r", "gen/** linguist-generated\n*.js -linguist-generated\n"), ("r/gen", "*.js linguist-generated\n")], ["r/gen/a.js", "r/gen/b/a.js", "r/a.js"]) == [True, True, False]
    assert told(spark, [("r", '[attr]tool linguist-generated -diff\n"a b.js" tool\nc.js -tool\nd.js generated -generated\n')], ["r/a b.js", "r/c.js", "r/d.js"]) == [True, False, False]
    assert told(spark, [("", "*.js linguist-generated\n")], ["r/a.js", "a.js"]) == [True, True]


def test_directories(spark):
    assert spark.createDataFrame([("r/a/b.js",), ("x",)], "path string").select(directories(F.col("path")).alias("d")).collect() == [(["", "r", "r/a"],), ([""],)]


def test_patterns():
    assert {"*_pb2.py", "*_x_pb2.py", "**/gen/**"} <= set(path_patterns("repo/gen/a_x_pb2.py"))
    assert "*Grpc.java" in path_patterns("repo/a/ThingGrpc.java") and path_patterns("repo/a.py") == []


FILES = "path string, generated int, indexed_at bigint, evidence string, repository string"


def test_not_handwritten(spark):
    files = [(f"r{i}/src/a{i}.zz.py", 1, 1, "c", "c") for i in range(6)] + [("r9/src/b.zz.py", 0, 1, "c", "c"), ("r8/a.py", 1, 1, "c", "c"), ("r8/a.py", 0, 2, "c", "c"), ("r7/kept.js", None, 1, "c", "c"), (None, 1, 1, "c", "c")]
    files += files[:2]
    texts = [("r9/src/b.zz.py", HAND), ("r8/a.py", HAND), ("r7/.gitattributes", "*.js -linguist-generated\nx.py linguist-generated\nthird/** linguist-vendored\n"), ("r7/kept.js", MINIFIED), ("r7/x.py", HAND), ("r7/third/a/b.py", HAND), ("r6/only_text.js", MINIFIED), ("r6/null.py", None), (None, MINIFIED),
             ("r6/node_modules/x/a.js", HAND), ("r6/external/a.js", HAND), ("r6/a_pb2.py", HAND), ("r6/b_pb2.py", "# Written by hand.\n" + HAND)]
    got = not_handwritten(spark.createDataFrame(files, FILES), spark.createDataFrame(texts, "path string, text string")).collect()
    want = {f"r{i}/src/a{i}.zz.py": "declared" for i in range(6)} | {"r9/src/b.zz.py": "mined", "r7/x.py": "declared", "r7/third/a/b.py": "declared", "r6/only_text.js": "minified", "r6/node_modules/x/a.js": "named", "r6/a_pb2.py": "named"}
    assert {r.path: r.reason for r in got} == want and len(got) == len(want)
    empty = not_handwritten(spark.createDataFrame([], FILES), spark.createDataFrame([], "path string, text string"))
    assert empty.collect() == []


def test_attribute_files_are_what_patterns_are_mined_from(spark):
    # five repositories declare their output folders and tool names; a sixth declares nothing
    texts = [(f"r{i}/.gitattributes", "out/** linguist-generated\n*_tool.rs linguist-generated\n") for i in range(5)]
    texts += [(f"r{i}/out/d/a{k}.rs", HAND) for i in range(5) for k in range(2)] + [(f"r{i}/src/b{k}_tool.rs", HAND) for i in range(5) for k in range(2)] + [(f"r{i}/src/plain{k}.rs", HAND) for i in range(6) for k in range(9)]
    texts += [("u/out/x.rs", HAND), ("u/src/y_tool.rs", HAND), ("u/out/kept.rs", "// Maintained by hand.\n" + HAND)]
    frames = spark.createDataFrame([], FILES), spark.createDataFrame(texts, "path string, text string")
    reasons = {r.path: r.reason for r in not_handwritten(*frames).collect()}
    assert {p for p, r in reasons.items() if r == "mined"} == {"u/out/x.rs", "u/src/y_tool.rs"} and sum(r == "declared" for r in reasons.values()) == 20 and len(reasons) == 22
    assert {"**/out/**", "*_tool.rs"} <= {r.pattern for r in patterns_in_use(*frames).collect()}


def test_chance_hits_make_no_pattern(spark):
    rng = random.Random(3)
    rows = [(f"r{rng.randrange(40)}/src/word_{i}.js", i % 3 == 0) for i in range(60)] + [(f"r{i}/src/x{i}_gen.js", i < 16) for i in range(17)]
    got = {r.pattern for r in mined_patterns(spark.createDataFrame(rows, "path string, marked boolean")).collect()}
    assert "*_gen.js" in got and "word_*.js" not in got and "**/src/**" not in got


@pytest.mark.parametrize("n", [15_000, 20_000, 25_000, 400_000])
def test_literals_of_any_length(n):
    assert literal_data('DATA = "' + "QUJD" * (n // 4) + '"\n')
    assert literal_data("X = [" + '"ab\\"c", ' * (n // 9) + "]\n")
    assert literal_data("1" * n + "\n") and not literal_data("1" * n + "x\n") and not literal_data("'a' + call(b) + " * (n // 17) + "c\n")


def test_project_named_below_a_long_licence():
    licence = "".join(f"# Line {i} of a licence that grants and denies this and that to whom it may concern.\n" for i in range(700))
    assert foreign_head("repo/a.py", licence + "# Copyright (c) 2019 The other7 contributors\n\nx = 1\n") == "other7"
    assert foreign_head("repo/a.py", licence + "x = 1\n# Copyright (c) 2019 The other7 contributors\n") is None


def test_repositories_are_counted_exactly(spark):
    # any three of 200 names: some share a bucket of 64
    rows = [(f"r{r}/a{k}.n{i}.py", True) for i in range(60) for r in (i, i + 60, i + 120) for k in range(2)]
    got = {r.pattern: (r.n_files, r.n_marked) for r in mined_patterns(spark.createDataFrame(rows, "path string, marked boolean")).collect()}
    assert {f"*.n{i}.py" for i in range(60)} <= set(got) and got["*.n0.py"] == (6, 6)
