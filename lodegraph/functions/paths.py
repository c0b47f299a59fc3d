"""Column functions over paths: parts, language, proximity, and the classes of files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and their languages.
LANGUAGE_OF = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "py": "python", "pyw": "python", "pyi": "python", "go": "go", "rs": "rust",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cu": "cuda", "cuh": "cuda", "metal": "metal", "cs": "csharp", "php": "php", "rb": "ruby", "rake": "ruby",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin", "dart": "dart", "scala": "scala", "sc": "scala", "lua": "lua", "luau": "luau", "r": "r", "m": "objc", "mm": "objc", "pas": "pascal", "dpr": "pascal", "erl": "erlang", "hrl": "erlang",
    "nix": "nix", "sol": "solidity", "tf": "terraform", "hcl": "terraform", "gd": "gdscript", "tscn": "godot_scene", "tres": "godot_resource", "cfm": "cfml", "cfc": "cfml", "ets": "arkts", "vue": "vue", "svelte": "svelte", "astro": "astro",
    "razor": "razor", "cshtml": "razor", "liquid": "liquid", "xml": "xml", "yaml": "yaml", "yml": "yaml", "twig": "twig",
}
TEST_FILE = r"(^|/)(test|tests|__tests__|spec|e2e)/|\.test\.|\.spec\.|_test\."
NON_PRODUCTION = r"(?i)(^|/)(tests?|__tests__|specs?|e2e|testing|testdata|test_data|__mocks__|mocks?|fixtures?|examples?|demos?|samples?|benchmarks?|bench|integration)/|(^|/)(test_|spec_)[^/]*$|[._-](test|tests|spec|specs)\.[^/]*$|(^|/)(conftest|testing)\.[a-z]+$"
CAMEL_TEST = r"[a-z0-9](Test|Tests|TestCase|Spec|Specs)\.[a-z]+$"
GENERATED_PATH = r"(\.pb\.go|\.pb\.cc|\.pb\.h|_pb2\.py|_pb2_grpc\.py|_pb2\.pyi|\.pb\.ts|_pb\.js|_pb\.ts|_pb\.rb|_grpc\.pb\.go|_services_pb\.rb|\.generated\.[a-z]+|\.gen\.[a-z]+|_gen\.go|_generated\.[a-z]+|\.g\.dart|\.freezed\.dart|\.designer\.cs|OuterClass\.java|Grpc\.java|\.min\.js|\.bundle\.js)$|(^|/)(mock_[^/]*\.go|zz_generated[^/]*\.go)$"
# Directories that a scan skips by default.
IGNORED_DIRS = "node_modules bower_components jspm_packages vendor dist build out target bin obj coverage .git .hg .svn .next .nuxt .cache .venv venv env __pycache__ .mypy_cache .pytest_cache .tox .gradle .idea .vscode Pods Carthage DerivedData .terraform elm-stuff _build deps .dart_tool tmp temp logs".split()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """The language by extension, overrides first; 'unknown' otherwise."""
    table = LANGUAGE_OF | (overrides or {})
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(lookup[extension(path)], F.lit("unknown"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash, '' without one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def directories(path: Column) -> Column:
    """Every directory above ``path``, '' included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def normalized(path: Column) -> Column:
    """Lexical normalisation: '.' and '' fall away, '..' takes its parent with it, leading '..' stay."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def shared_directories(a: Column, b: Column) -> Column:
    """How many leading directories two paths have in common."""
    da, db = F.split(dirname(a), "/"), F.split(dirname(b), "/")
    same = F.zip_with(da, db, lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct((acc["n"] + F.when(acc["on"] & x, 1).otherwise(0)).alias("n"), (acc["on"] & x).alias("on")), lambda acc: acc["n"])


def proximity(a: Column, b: Column) -> Column:
    """15 points per shared leading directory, 80 at most."""
    return F.least(F.lit(15) * shared_directories(a, b), F.lit(80))


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def is_non_production(path: Column) -> Column:
    return path.rlike(NON_PRODUCTION) | path.rlike(CAMEL_TEST)


def is_generated_path(path: Column) -> Column:
    return path.rlike(GENERATED_PATH)


def is_path_shaped(text: Column) -> Column:
    """A reference that names a file: a slash or a short extension, no blanks and no scheme but ``res://``."""
    return (text.rlike(r"/|\.[A-Za-z0-9]{1,5}$")) & ~text.rlike(r"\s|^[a-z][a-z0-9+.-]*:") | text.startswith("res://")


def glob_regex(pattern: str) -> str:
    """``*`` within a segment, ``**`` across segments, ``?`` one character, as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def ignored(path: Column, patterns: list[str], default_dirs: list[str] | None = None) -> Column:
    """Ordered ignore fold: skipped directories first, then the patterns; the last that matches decides, ``!`` re-includes."""
    dirs = "|".join(map(re.escape, IGNORED_DIRS if default_dirs is None else default_dirs))
    result = path.rlike(f"(^|/)({dirs})/") if dirs else F.lit(False)
    for pattern in patterns:
        negated = pattern.startswith("!")
        body = pattern.lstrip("!").strip("/")
        anchored = "/" in pattern.lstrip("!").rstrip("/")
        regex = glob_regex(body)[1:-1]
        regex = f"^{regex}(/|$)" if anchored else f"(^|/){regex}(/|$)"
        result = F.when(path.rlike(regex), F.lit(not negated)).otherwise(result)
    return result
