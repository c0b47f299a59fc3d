import random

from lodegraph.operators import sync as S

TEXT = "path string, text string"
BEFORE = {
    "a/core.py": "import os\n\nclass Base:\n    def load(self):\n        return 1\n\ndef helper():\n    return Base()\n",
    "a/use.py": "from core import helper\n\nclass Leaf(Base):\n    def run(self):\n        return helper()\n\ndef other():\n    return only_here()\n",
    "a/lone.py": "def only_here():\n    return missing()\n",
    "b/x.ts": "export class B extends C {\n  run() { helper(1); }\n}\nfunction g() { return 1; }\n",
    "b/gone.py": "def missing():\n    return helper()\n",
}
AFTER = {**{k: v for k, v in BEFORE.items() if k != "b/gone.py"}, "a/core.py": BEFORE["a/core.py"].replace("helper", "assist"), "a/lone.py": "# moved down\n" + BEFORE["a/lone.py"], "c/new.py": "def helper():\n    return other()\n", "c/null.py": None}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()) + [(None, "x")], TEXT)


def rows(tables):
    return {name: sorted(map(str, (S.edges(tables) if name == "edges" else tables[name]).collect())) for name in ("files", "nodes", "refs", "edges", "resolved")}


def test_an_edit_equals_a_rebuild(spark):
    synced, touched = S.sync(S.build(frame(spark, BEFORE)), frame(spark, AFTER))
    full = S.build(frame(spark, AFTER))
    a, b = rows(synced), rows(full)
    # columns may stand in another order, so edges and counts are compared as sets of rows
    assert a["edges"] == b["edges"] and a["resolved"] == b["resolved"] and a["nodes"] == b["nodes"]
    assert touched["files"] == 5 and 0 < touched["refs"] < full["refs"].count() + 5
    assert all(r.n_differing == 0 for r in S.differing(synced, full).collect())
    assert any(r.n_differing for r in S.differing(S.build(frame(spark, BEFORE)), full).collect())


def test_random_edits_equal_a_rebuild(spark):
    rng = random.Random(3)
    names = [f"fn{i}" for i in range(8)]

    def project(k):
        return {f"d{i % 3}/m{i}.py": "".join(f"def {rng.choice(names)}():\n    return {rng.choice(names)}()\n\n" for _ in range(rng.randint(0, 4))) for i in range(k)}

    before = project(6)
    for _ in range(1):
        after = dict(before)
        for path, text in project(7).items():
            if rng.random() < 0.5:
                after[path] = text
        after.pop(rng.choice(sorted(after)))
        synced, _ = S.sync(S.build(frame(spark, before)), frame(spark, after))
        assert all(r.n_differing == 0 for r in S.differing(synced, S.build(frame(spark, after))).collect())
        before = after


def test_the_index_survives_a_run_that_died(spark, tmp_path, monkeypatch):
    index = S.ProjectIndex(spark, f"file://{tmp_path}/index")
    index.build(frame(spark, BEFORE))
    assert index.sync(frame(spark, BEFORE)) == {"files": 0, "symbols": 0, "refs": 0}
    with monkeypatch.context() as patch:
        patch.setattr(index, "_publish", lambda tables: 1 / 0)
        try:
            index.sync(frame(spark, AFTER))
        except ZeroDivisionError:
            pass
    assert index.meta.get(S.INCOMPLETE) == "1" and sorted(r.path for r in index.read()["files"].collect()) == sorted(BEFORE)
    touched = index.sync(frame(spark, AFTER))
    assert touched["refs"] == index.read()["refs"].count()  # all of them once more
    assert index.meta.get(S.INCOMPLETE) is None and all(r.n_differing == 0 for r in S.differing(index.read(), S.build(frame(spark, AFTER))).collect())
    index.meta.set("note", "x")
    assert index.meta.get("note") == "x"
    index.meta.delete("note")
    assert index.meta.get("note") is None


def test_empty_projects(spark):
    nothing = S.build(frame(spark, {}))
    assert nothing["nodes"].count() == 0
    synced, _ = S.sync(nothing, frame(spark, BEFORE))
    assert all(r.n_differing == 0 for r in S.differing(synced, S.build(frame(spark, BEFORE))).collect())
