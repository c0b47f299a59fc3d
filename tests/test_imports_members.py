from lodegraph.operators import imports as I
from lodegraph.operators import members as M

TEXT = "path string, text string"


def test_bindings_of_every_language(spark):
    texts = [
        ("r/a.ts", "import { a as b, type C } from './x';\nimport d from \"y\";\r\nimport * as e from '@/z';\nconst f = require('g');\n"), ("r/a.py", "from ..pkg.mod import one, two as three\nimport os.path\n"), ("r/a.go", 'import (\n\t"net/http"\n\tj "x/json"\n)\n'),
        ("r/A.java", "import org.acme.Thing;\nimport static a.B.*;\n"), ("r/a.rs", "use crate::m::{one, two as t};\npub use a::b::C;\n"), ("r/a.rb", "require 'set'\nrequire_relative \"lib/x\"\n"), ("r/a.c", '#include "dir/h.h"\n#include <stdio.h>\n'), ("r/n.py", None), (None, "import x"), ("r/a.txt", "import x\n"),
    ]
    got = {(r.path, r.local, r.imported, r.source) for r in I.import_mappings(spark.createDataFrame(texts, TEXT)).collect()}
    assert got == {
        ("r/a.ts", "b", "a", "./x"), ("r/a.ts", "C", "C", "./x"), ("r/a.ts", "d", "default", "y"), ("r/a.ts", "e", "*", "@/z"), ("r/a.ts", "f", "default", "g"), ("r/a.py", "one", "one", "..pkg.mod"), ("r/a.py", "three", "two", "..pkg.mod"), ("r/a.py", "os", "*", "os.path"),
        ("r/a.go", "http", "*", "net/http"), ("r/a.go", "json", "*", "x/json"), ("r/A.java", "Thing", "Thing", "org.acme"), ("r/A.java", "*", "*", "a.B"), ("r/a.rs", "one", "one", "crate::m"), ("r/a.rs", "t", "two", "crate::m"), ("r/a.rs", "C", "C", "a::b"),
        ("r/a.rb", "set", "*", "set"), ("r/a.rb", "x", "*", "lib/x"), ("r/a.c", "h", "*", "dir/h.h"), ("r/a.c", "stdio", "*", "stdio.h"),
    }


FILES = ["r/src/a.ts", "r/src/b.ts", "r/src/b.js", "r/src/c/index.ts", "r/src/c/d.tsx", "r/pkg/mod.py", "r/pkg/__init__.py", "r/pkg/sub/deep.py", "r/inc/h.h", "r/src/app/util.ts", "r/packages/core/src/x.ts", "q/src/b.ts"]


def test_specifiers_lead_to_files(spark):
    asked = [("r/src/a.ts", "./b", "r/src/b.ts"), ("r/src/a.js", "./b", "r/src/b.js"), ("r/src/a.ts", "./c", "r/src/c/index.ts"), ("r/src/c/d.tsx", "../b", "r/src/b.ts"), ("r/src/c/index.ts", "@/b", "r/src/b.ts"), ("r/pkg/sub/deep.py", "..mod", "r/pkg/mod.py"), ("r/pkg/sub/deep.py", "pkg.mod", "r/pkg/mod.py"), ("r/x.py", "pkg", "r/pkg/__init__.py"),
             ("r/src/m.c", "inc/h.h", "r/inc/h.h"), ("r/src/a.ts", "react", None), ("r/src/a.ts", "../../../x", None), ("r/src/z.ts", "#app/util", "r/src/app/util.ts"), ("r/src/z.ts", "@acme/core/src/x", "r/packages/core/src/x.ts"), (None, "./b", None), ("r/src/a.ts", None, None)]
    configs = [("r/tsconfig.json", '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"#app/*": ["src/app/*"],}},\n}'), ("r/package.json", '{"name": "root", "workspaces": ["packages/*"]}'), ("r/packages/core/package.json", '{"name": "@acme/core"}'), ("r/go.mod", "module acme.org/r\n\ngo 1.22\n"), ("r/bad/tsconfig.json", "not json")]
    aliases = I.project_aliases(spark.createDataFrame(configs, TEXT))
    assert {(r.directory, r.prefix, r.target) for r in aliases.collect()} == {("r", "#app/", "r/src/app/"), ("r", "@acme/core", "r/packages/core"), ("r", "acme.org/r", "r")}
    got = {(r.path, r.source): r.target for r in I.resolve_specifiers(spark.createDataFrame([a[:2] for a in asked], "path string, source string"), spark.createDataFrame([(f,) for f in FILES], "path string"), aliases).collect()}
    assert got == {(p, s): t for p, s, t in asked if t}


NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, start_column int, is_exported int"


def node(i, kind, name, path="a.py", language="python", line=1, exported=0, qualified=None):
    return (i, kind, name, qualified or name, path, language, line, 0, exported)


def test_imported_names_and_reexports(spark):
    nodes = spark.createDataFrame([node("1", "function", "f", "x.ts", exported=0), node("2", "function", "f", "x.ts", line=9, exported=1), node("3", "class", "K", "y.ts"), node("4", "method", "m", "y.ts"), node("5", "file", "f", "x.ts")], NODE)
    refs = spark.createDataFrame([(1, "g", "a.ts"), (2, "f", "a.ts"), (3, "K.m", "a.ts"), (4, "nothing", "a.ts"), (5, None, "a.ts")], "ref_id bigint, reference_name string, file_path string")
    bindings = spark.createDataFrame([("a.ts", "g", "f", "x.ts"), ("a.ts", "K", "K", "y.ts")], "path string, local string, imported string, target_path string")
    assert {r.ref_id: r.target for r in I.imported_symbols(refs, bindings, nodes).collect()} == {1: "2", 3: "4"}
    exports = spark.createDataFrame([("c.ts", "A", "1"), ("c.ts", "B", "2"), ("b.ts", "B", "3")], "path string, name string, id string")
    named = spark.createDataFrame([("a.ts", "Z", "A", "b.ts"), ("d.ts", "A", "A", "e.ts"), ("e.ts", "A", "A", "d.ts")], "path string, name string, imported string, target_path string")
    stars = spark.createDataFrame([("b.ts", "c.ts"), ("c.ts", "b.ts")], "path string, target_path string")
    got = {(r.path, r.name): (r.id, r.hops) for r in I.exported_through(exports, named, stars).collect()}
    assert got == {("c.ts", "A"): ("1", 0), ("c.ts", "B"): ("2", 0), ("b.ts", "B"): ("3", 0), ("b.ts", "A"): ("1", 1), ("a.ts", "Z"): ("1", 2)}


def test_jvm_imports_take_the_nearest(spark):
    nodes = spark.createDataFrame([node("1", "class", "T", "m/x/T.java", "java", qualified="p::T"), node("2", "class", "T", "n/y/T.java", "java", qualified="p::T"), node("3", "class", "T", "n/T.py", qualified="p::T")], NODE)
    asked = spark.createDataFrame([("i", "n/y/A.java", "p.T"), ("j", "m/x/A.java", "p.T"), ("k", "m/A.java", "p.U")], "import_id string, path string, name string")
    assert {r.import_id: r.target for r in I.jvm_imports(asked, nodes).collect()} == {"i": "2", "j": "1"}


def graph(spark):
    nodes = [node("B", "class", "Base"), node("L", "class", "LeafNode"), node("b1", "method", "run"), node("b2", "method", "stop", line=5), node("l1", "method", "run", line=9), node("o", "class", "Other", language="go"), node("o1", "method", "only", language="go"), node("mk", "function", "make", line=20)]
    links = [("B", "b1", "contains"), ("B", "b2", "contains"), ("L", "l1", "contains"), ("o", "o1", "contains"), ("L", "B", "extends"), ("B", "L", "extends"), ("mk", "L", "returns")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(links, "source string, target string, kind string")


def test_methods_on_types_with_a_cycle_of_supertypes(spark):
    nodes, links = graph(spark)
    table = M.method_table(nodes, links)
    assert {(r.type_id, r.name): (r.id, r.depth) for r in table.collect()} == {("B", "run"): ("b1", 0), ("B", "stop"): ("b2", 0), ("L", "run"): ("l1", 0), ("L", "stop"): ("b2", 1), ("o", "only"): ("o1", 0)}
    calls = spark.createDataFrame([(x, g) for x, g in [("make().stop", "python"), ("A.make()::run", "python"), ("make().gone", "python"), ("make().stop", "go"), (None, "go")]], "reference_name string, language string")
    assert {(r.reference_name, r.language): r.target for r in M.factory_chains(calls, nodes, links.filter("kind = 'returns'"), table).collect()} == {("make().stop", "python"): "b2", ("A.make()::run", "python"): "l1"}
    empty = nodes.limit(0)
    assert M.method_table(empty, links.limit(0)).collect() == []


def test_method_calls_by_receiver(spark):
    nodes, links = graph(spark)
    methods = M.methods_of_types(nodes, links)
    calls = spark.createDataFrame([(x, "python") for x in ("LeafNode.run", "leafNode.run", "theLeafNode.run", "it.stop", "it.run", "plain", None)] + [("x.only", "go"), ("x.only", "python")], "reference_name string, language string")
    got = {(r.reference_name, r.language): (r.target, r.confidence) for r in M.method_calls(calls, methods).collect()}
    assert got == {("LeafNode.run", "python"): ("l1", 0.85), ("leafNode.run", "python"): ("l1", 0.8), ("theLeafNode.run", "python"): ("l1", 0.65), ("it.stop", "python"): ("b2", 0.7), ("x.only", "go"): ("o1", 0.7)}
    assert {r.reference_name for r in M.method_calls(calls, methods, ceiling=1).collect()} == {"it.stop", "x.only"}


def test_receiver_types_from_text(spark):
    text = "x = Outer()\ndef f(p: Part):\n    x = Leaf(1)\n    x.run()\n    p.go()\n    y.no()\n\ndef g():\n    x.run()\n"
    java = "class A { void f(Thing t) {\n  Other o = make();\n  t.go(); o.run();\n} }\n"
    scopes = spark.createDataFrame([("a.py", 2, 6), ("a.py", 8, 9), ("A.java", 1, 4)], "path string, start_line int, end_line int")
    got = {(r.path, r.line, r.receiver): r.type_name for r in M.receiver_types(spark.createDataFrame([("a.py", text), ("A.java", java), ("n.py", None)], TEXT), scopes).collect()}
    assert got == {("a.py", 4, "x"): "Leaf", ("a.py", 5, "p"): "Part", ("A.java", 3, "t"): "Thing", ("A.java", 3, "o"): "Other"}
