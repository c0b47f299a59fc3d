import pytest

from lodegraph.llm.docpairs import code_description_pairs, file_islands, indexed_pairs
from lodegraph.llm.doctext import description, telling
from lodegraph.llm.islands import islands, parameters

SAYS_NOTHING = [
    None, "", "  \n ", "/** */", "----------", "TODO", "TODO: document", "FIXME write docs (team-a)", "TODO\n - docs\n - tests", "todo document this", "XXX", "N/A", "Description missing", "No description.", "Beschreibung fehlt", "à compléter", "待补充",
    "Auto-generated method stub", "Created by wizard", "Created 2019-04-11", "docs-guild 07/2018", "@author team-a\n@since 2.0", "@param path\n@returns", ":param path:\n:return:", "Args:\n    path:\nReturns:", "\\param path\n\\return", "@see Other", "@deprecated since 3.1",
    "{@inheritDoc}", "load_file.", "Loads the file.", "This method loads the file.", "Function load_file()", "The load_file method.", "LOAD FILE", "eslint-disable-next-line no-shadow", "noqa: E501", "type: ignore", "#region helpers", "============ api ============",
    "SPDX-License-Identifier: MIT", "Copyright 2019 the authors\nUse is subject to the licence in LICENCE.txt", "if (x) { walk(x); }", "a = f(b, 3);\nreturn a;", "<summary></summary>", "@override", "[summary]", "...",
]
SAYS = [
    "Never frees the slab.", "/**\n * Keeps insertion order.\n */", "Returns the first entry, or nothing if the cache is cold.", "@deprecated since 3.1\nBlocks until the writer drains.", "TODO: handle unicode. Skips everything already seen.", "FIXME(me) slow. Walks all entries twice.",
    "按路径排序后返回每个引用的数量。", "Liefert den Eintrag ohne Sperre.", "<p>Reads at most one block.</p>", "@internal\nCaller must hold the lock.", "@param path the input\n@returns see below\n\nOpens lazily and caches handles.", "// source -> sink: one copy per entry, before the lock is released",
]


@pytest.mark.parametrize("doc", SAYS_NOTHING)
def test_says_nothing(doc):
    assert telling(doc, "load_file", "(path) -> str") == ""


@pytest.mark.parametrize("doc", SAYS)
def test_says_something(doc):
    assert telling(doc, "load_file", "(path) -> str") != ""


def test_description_drops_marks_and_keeps_sentences():
    assert description("/**\n * Opens the file.\n * @param path where\n * Copyright 2020 the authors\n */") == "Opens the file."


SOURCES = {
    "a.py": ("x = 1\n\n# Says it.\n@deco\ndef f(a,\n      b):\n    '''Doc } {'''\n    if a:\n        return b\n\n\ndef g():\n    pass\n", {("f", 5, 9), ("g", 12, 13)}),
    "a.ts": ("// } {\nexport class A {\n  /** Doc. */\n  async run(x: string): Promise<void> {\n    const s = `}${x}`;\n    if (x) { call(); }\n  }\n}\nexport const h = (a: number) => {\n  return a;\n};\n", {("run", 4, 7), ("h", 9, 11)}),
    "a.go": ('package p\n\n// Doc.\nfunc (s *S) Get(a []string) (int, error) {\n\tx := "}"\n\treturn 1, nil\n}\n', {("Get", 4, 7)}),
    "a.rs": ("/// Doc\n#[inline]\npub fn get<'a>(x: &'a str) -> char {\n    '}'\n}\nfn decl();\n", {("get", 3, 5)}),
    "A.java": ("class A {\n  @Override\n  public List<String> get(int a) throws E {\n    return x;\n  }\n  abstract int no();\n}\n", {("get", 3, 5)}),
    "a.c": ("/* Doc */\nstatic char * get(int a) {\n  while (a) { a--; }\n  return 0;\n}\nint no(void);\n", {("get", 2, 5)}),
    "a.rb": ("class A\n  # Doc\n  def get(a)\n    if a\n      1\n    end\n  end\n  def self.other\n  end\nend\n", {("get", 3, 7), ("other", 8, 9)}),
}


@pytest.mark.parametrize("path", SOURCES)
def test_islands(path):
    text, want = SOURCES[path]
    found = list(islands(path, text))
    assert {(i.name, i.start_line, i.end_line) for i in found} == want
    assert all(text.replace("\r\n", "\n").split("\n")[i.start_line - 1].strip() in i.code for i in found)


def test_island_documentation_and_odd_inputs():
    found = {i.name: i for i in islands("a.ts", SOURCES["a.ts"][0])}
    assert found["run"].doc == "/** Doc. */" and found["run"].signature.startswith("async run(x: string)")
    assert [i.doc for i in islands("a.py", SOURCES["a.py"][0]) if i.name == "f"] == ["'''Doc } {'''"]
    assert list(islands("a.xyz", "def f():\n  pass")) == [] and list(islands(None, "x")) == [] and list(islands("a.py", None)) == [] and list(islands("a.js", "")) == []
    assert list(islands("a.js", "function f() {" * 50)) == []
    assert [i.name for i in islands("a.js", "function f() {\r\n}\r\n")] == ["f"]


NODES = "id string, kind string, name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, updated_at bigint, path string, found string"


def node(i, kind="function", name="f", path="a.py", line=5, doc="Keeps order and never blocks.", at=1):
    return (i, kind, name, path, "python", line, 9, doc, None, at, "clash", "clash")


def test_pairs(spark):
    nodes = [node("1"), node("1"), node("2", at=1), node("2", doc="TODO", at=2), node("3", doc="TODO", at=1), node("3", at=2), node("4", kind="class"), node("5", name=None), node("6", path=None), node("7", path="gone.py"), node(None), node("8", doc=None), node("9", line=None)]
    texts = spark.createDataFrame([("a.py", SOURCES["a.py"][0], 1), ("b.py", None, 1), (None, "def f(): pass", 1)], "path string, text string, name int")
    got = {r.id: r for r in code_description_pairs(spark.createDataFrame(nodes, NODES), texts).collect()}
    assert set(got) == {"1", "3", "5", "6", "7", "9"} and {r.documented_by for r in got.values()} == {"index"}
    assert got["1"].code.startswith("def f(a,") and got["1"].same_span and got["1"].signature.startswith("def f(a, b)")
    assert got["5"].code is None and got["7"].code is None and got["7"].start_line == 5
    assert code_description_pairs(spark.createDataFrame([], NODES), texts).collect() == []
    assert file_islands(texts.limit(0)).collect() == []


def test_documentation_in_the_source_alone(spark):
    text = "# Keeps order and never blocks.\ndef f(a):\n    return a\n\n\ndef g(a):\n    return a\n"
    nodes = spark.createDataFrame([node("1", doc=None, line=2), node("2", doc="TODO", line=2), node("3", name="g", doc=None, line=6), node("4", name="g", doc="Blocks until done.", line=6)], NODES)
    texts = spark.createDataFrame([("a.py", text)], "path string, text string")
    got = {r.id: (r.documented_by, r.description) for r in code_description_pairs(nodes, texts).collect()}
    assert got == {"1": ("source", "Keeps order and never blocks."), "2": ("source", "Keeps order and never blocks."), "4": ("index", "Blocks until done.")}
    assert [r.id for r in indexed_pairs(nodes, texts).collect()] == ["4"]


def test_the_island_gives_the_signature_the_index_lacks(spark):
    text = "def f(shard, ticket):\n    return shard\n"
    nodes = spark.createDataFrame([node("1", doc="The shard of the ticket.", line=1), node("2", doc="The shard of the glyph.", line=1), node("3", doc="The shard of the ticket.", path="gone.py", line=1)], NODES)
    got = {r.id for r in indexed_pairs(nodes, spark.createDataFrame([("a.py", text)], "path string, text string")).collect()}
    assert got == {"2", "3"}  # without a file the parameters are not known


@pytest.mark.parametrize("language,signature,names", [
    ("python", "(self, path: Path, *args, n: int = 3, **more) -> Config", ["self", "path", "args", "n", "more"]), ("typescript", "(vertex?: boolean, batch: Map<string, number>): number", ["vertex", "batch"]), ("typescript", "({ a, b }: P, c = (1, 2))", ["a", "b", "c"]),
    ("go", "func (s *S) Get(a []string, b map[string]int) (int, error)", ["a", "b"]), ("go", "(antenna string) bool", ["antenna"]), ("rust", "(&mut self, mut x: u32) -> u32", ["mut", "x"]), ("java", "List<String> (final int stencil, Map<String, List<X>> polygon)", ["stencil", "polygon"]),
    ("c", "static int Get(char *a[], const struct x *b)", ["a", "b"]), ("ruby", "(satchel, token: 1, &block)", ["satchel", "token", "block"]), ("python", None, []), ("python", "no paren", []), ("python", "(", []),
])
def test_parameters(language, signature, names):
    assert parameters(signature, "Get", language) == names


@pytest.mark.parametrize("doc", ["Idempotent.", "Thread-safe.", "Loads the config.", "@return bytes flushed, or -1 once closed", ":raises KeyError: if the lease has run out", "Returns:\n    The number of retries."])
def test_one_thing_is_enough(doc):
    assert telling(doc, "load_file", "(path: Path) -> Config", "python") != ""


@pytest.mark.parametrize("doc", ["Loads the path.", "@return Config", "@return the result", "@return the path", "Returns: Config", "@throws IOException", "Constructor.", "Helper function."])
def test_names_and_types_tell_nothing(doc):
    assert telling(doc, "load_file", "(path: Path) -> Config", "python") == ""


def test_heads_and_annotations_of_any_length():
    far = "/** Doc. */\n" + "@A(b(1), c = 2)\n" * 400 + "void f() {\n}\n"
    assert [i.doc for i in islands("a.java", far)] == ["/** Doc. */"]
    long = "def f(\n" + "".join(f"    a{i},\n" for i in range(600)) + "):\n    '''Doc.'''\n    return 1\n"
    assert [(i.start_line, i.end_line, i.doc) for i in islands("a.py", long)] == [(1, 604, "'''Doc.'''")]
