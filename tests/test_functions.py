from pyspark.sql import functions as F

from lodegraph.functions.names import kebab_to_pascal, plain_word, segments, snake_to_camel, stems
from lodegraph.functions.paths import basename, dirname, ignored, is_generated_path, is_path_shaped, is_test_file, language_of, normalized, proximity
from lodegraph.functions.routes import page_route, wire_name


def column(spark, values, *exprs):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_paths(spark):
    x = F.col("x")
    assert column(spark, ["a/b/c.PY", "top", "a/./b/../c.go", "../x", "a/../../y"], basename(x), dirname(x), normalized(x)) == [("c.PY", "a/b", "a/b/c.PY"), ("top", "", "top"), ("c.go", "a/./b/..", "a/c.go"), ("x", "..", "../x"), ("y", "a/../..", "../y")]
    assert column(spark, ["a.py", "b.TS", "c", "d.foo"], language_of(x), language_of(x, {"foo": "bar"})) == [("python", "python"), ("typescript", "typescript"), ("unknown", "unknown"), ("unknown", "bar")]
    assert column(spark, ["tests/a.py", "a.test.js", "latest/a.py"], is_test_file(x)) == [(True,), (True,), (False,)]
    assert column(spark, ["a_pb2.py", "x/mock_a.go", "generated.py"], is_generated_path(x)) == [(True,), (True,), (False,)]
    assert column(spark, ["a/b.py", "res://x", "word", "http://x/y", "two words/x"], is_path_shaped(x)) == [(True,), (True,), (False,), (False,), (False,)]
    assert column(spark, ["a/b/c.py", "a/x.py", "z.py"], proximity(x, F.lit("a/b/d.py"))) == [(30,), (15,), (0,)]
    assert column(spark, ["dist/a.js", "dist/keep.js", "src/a.js", "src/a.min.js"], ignored(x, ["*.min.js", "!dist/keep.js"])) == [(True,), (False,), (False,), (True,)]


def test_names(spark):
    x = F.col("x")
    assert column(spark, ["parseHTTPHeader2", "snake_case", ""], F.array_join(segments(x), " ")) == [("parse http header2",), ("snake case",), ("",)]
    assert column(spark, ["do_a_thing", "one"], snake_to_camel(x)) == [("doAThing",), ("one",)]
    words = {"running": "run runn runne", "cities": "city", "go": "", "decision": "decis", "agreement": "agree", "boxes": "box", "tokens": "token", "class": "", "walked": "walk walke", "copied": "copi copie copy", "parser": "pars parse", "runner": "run runn runne", "feed": "", "ing": "", "er": "", "action": "act"}
    assert column(spark, list(words), F.array_join(stems(x), " ")) == [(w,) for w in words.values()]
    assert column(spark, ["Élan", "naïve", "Ångström", "e\u0301a", "日本"], plain_word(x)) == [("elan",), ("naive",), ("angstrom",), ("ea",), ("日本",)]
    assert column(spark, ["my-own-tag", "tag"], kebab_to_pascal(x)) == [("MyOwnTag",), ("Tag",)]
    assert column(spark, ["src/pages/blog/[slug].tsx", "pages/index.js", "lib/a.ts", "app/(shop)/item/page.tsx"], page_route(x)) == [("/blog/:slug",), ("/",), (None,), ("/item",)]
    assert column(spark, ["get_User-name"], wire_name(x)) == [("getusername",)]
