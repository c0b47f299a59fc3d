"""Generated, minified, vendored and data files, so that hand-written source remains.

Evidence, in this order:

1. repository attribute files (``.gitattributes`` among the texts): per path and mark the rule of the deepest
   directory, in it the last line and in that the last attribute decides.  A set mark makes a file generated or
   vendored, an unset one (``-mark``, ``mark=false``) keeps it, an unspecified one (``!mark``) takes earlier rules back;
2. ``files.generated``;
3. mined patterns, for repositories without attribute files: path patterns (name endings, name beginnings,
   directories) that, over all repositories, hold mostly files which are declared or which their own text gives
   away.  The Wilson bound of their share decides, so that a few chance hits make no pattern;
4. the text itself: generator banners in the head's comments, minified layout, heads that name another project,
   and literals that fill the file;
5. last, fixed names that tools give their output and folders of package managers.

A head that says the file is written by hand outweighs 3 and 5.

Plan: texts are judged where they are read and the verdicts written once.  Paths meet rules by directory and the
glob is matched as a regular expression in the JVM; a repository with a third of all files is a skewed join that
adaptive execution splits.  Patterns are exploded, counted with map-side partials (a hot pattern is one counter per
task) and joined back by pattern.  Nothing is collected.

Nulls: rows with a null path are ignored; a null or empty text gives no evidence of its own; a null flag declares
nothing.  Repeated rows of a path count once: the newest state declares (any state of equal time).  Empty tables
give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.islands import language
from lodegraph.plans.storage import Workspace
from lodegraph.sources.tables import newest

# What file heads say about their origin, and where copies of other projects are kept.
FILE_BANNER = re.compile(
    r"^@(?:partially-)?generated\b|\b(?:code|file|source|module|class|document|header|content|script)\b.{0,40}\b(?:auto[- ]?)?(?:generated|created|produced|built|emitted|written|compiled)\b.{0,30}\b(?:automatically|by|from|with|using)\b|"
    r"\b(?:file|code|source|module|header)\b.{0,20}\b(?:is|was|has been)\s+(?:auto[- ]?|automatically\s+|machine[- ]?)(?:generated|created|produced)|^(?:auto[- ]?|automatically\s+|machine[- ]?)?generated (?:by|from|with|using|on|at|code|file)\b|^auto[- ]?generated\b\W*(?:do not|changes|edits|file|code|by|from|$)|"
    r"^machine[- ](?:made|generated|written|produced)\b|\boutput of \S+|\b(?:hand|manual) (?:edits|changes) (?:are|will be|get)\b|\b(?:changes|edits|modifications)\b.{0,30}\bwill be (?:lost|overwritten|discarded)|\bregenerate (?:with|by|using)\b|\bnever edit by hand|"
    r"\b(?:do not|don'?t|never|please do not)\s+(?:manually\s+)?(?:edit|modify|change|touch)\b.{0,20}(?:$|this file|by hand|manually|directly|[.!;])|\bedit (?:that|the source|the template|the schema)\b.{0,12}instead|"
    r"自动生成|自動生成|请勿(?:手动)?(?:修改|编辑)|編集しないで|자동 생성|ne pas (?:modifier|éditer)|généré automatiquement|nicht (?:bearbeiten|ändern|editieren)|automatisch (?:erzeugt|generiert|erstellt)|no (?:editar|modificar)\b|generado automáticamente|gerado automaticamente|não (?:edite|modifique)|"
    r"generato automaticamente|non modificare|не (?:редактировать|изменять)|сгенерирован|автоматически создан",
    re.I,
)
NOT_FILE = re.compile(r"\bnot (?:auto[- ]?)?generated|\b(?:written|edited|maintained|made) by hand|\bhand[- ]?(?:written|made|maintained)|\bstub\b|\bchecks?(?:ed)? (?:for|that|whether)\b", re.I)
BY_HAND = re.compile(r"\bnot (?:auto[- ]?)?generated|\b(?:written|edited|maintained|made) by hand|\bhand[- ]?(?:written|made|maintained)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'|`[^`]*`|“[^”]*”|«[^»]*»")
OTHER_PROJECT = re.compile(
    r"^(?P<a>[\w.-]+)(?:\s+v?\d[\w.]*)?\s*[-–—:|,]\s*(?:\w+\s+){0,2}(?:released|licen[cs]ed|distributed|available) under\b|^(?P<b>[\w.-]+)(?:\s+v?\d[\w.]*)?\s*[-–—:|,]\s*(?:an? )?(?:upstream|verbatim|unmodified|vendored|imported|bundled|third[- ]party)\b|\bthis file is part of (?:the )?(?P<c>[\w.-]+?)(?: v?\d[\w.]*)?\.?$|\bcopyright\s+(?:\(c\)\s*|©\s*)?[\d, –-]*\s*(?:by\s+)?the (?P<d>[\w.-]+) (?:contributors|authors|developers|project|team|maintainers)\b|"
    r"\b(?:vendored|imported|copied|taken|forked|mirrored|bundled)\b.{0,20}\bfrom (?:the )?(?P<e>[\w.-]+)(?: v?\d[\w.]*)?(?:,| at | release| version|$)",
    re.I,
)
# Folders in which package managers keep other projects; names that mean other things too (deps, external, contrib) are left to mining and heads.
VENDOR_DIR = r"(?i)/(?:third[_-]?party|3rd-?party|node_modules|bower_components|jspm_packages|_?vendor|vendored|godeps|site-packages|dist-packages|pods|carthage)/"
TOOL_NAME = (
    r"(?:_pb2|_pb2_grpc|_pb2_twirp)\.pyi?$|\.pb(?:-c)?\.(?:go|cc?|h|cpp|dart|gw\.go)$|_grpc\.pb\.go$|_pb\.(?:js|ts|rb|d\.ts)$|_services_pb\.rb$|\.tab\.[ch](?:pp)?$|^lex\.\w+\.c$|^mock_\w+\.go$|_mocks?\.go$|_bindings\.rs$|^zz_generated|(?:Grpc|OuterClass)\.java$|"
    r"\.(?:gen|generated|g)\.(?:go|ts|tsx|js|jsx|mjs|rs|py|rb|java|dart|cs|c|h|cpp)$|_(?:gen|generated)\.(?:go|py|rs|rb|ts|js|c|h)$|\.designer\.cs$|[.-]min\.(?:js|mjs|css)$|\.bundle\.m?js$"
)
PREAMBLE = re.compile(r"#!|<\?|(?:package|import|from|use|using|require|include|extern crate|mod|namespace|module|syntax|option)\b|#\s*(?:include|pragma|define|ifndef|ifdef|endif)\b|['\"]use strict['\"]|\)|#!?\[|(?:const|var|let) .{0,80}= require\b")
COMMENT_LINE = re.compile(r"^\s*(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--|\"\"\"|''')!?\s?(.*?)\s*(?:\*+/|-->)?\s*$")
# Atomic: each literal is taken once, so the time is linear in the length of a line.
LITERALS = re.compile(r"^[\s\[({]*+(?:(?>(?:[-+]?(?:0x[\da-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[fFuUlL]*|[rb]?\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+')\s*+(?:,|=>|:)?\s*+))++[\])}\s,;]*+$")
LINE = re.compile(r"^\s*(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--|\"\"\"|''')!?\s?(.*?)\s*(?:\*+/|-->)?\s*$")
# Atomic: each literal is taken once, so the time is linear in the length of a line.
LITERALS = re.compile(r"^[\s\[({]*+(?:(?>(?:[-+]?(?:0x[\da-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[fFuUlL]*|[rb]?\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+')\s*+(?:,|=>|:)?\s*+))++[\])}\s,;]*+$")
HEAD_BYTES, HEAD_LINES = 8192, 60
LINE = re.compile(r"[^\n]*(?:\n|\Z)")

#: A pattern counts if so many marked files in so many repositories match it, and if the lower Wilson bound (at Z) of the marked share of
#: all files that match is so high.
MIN_MARKED, MIN_REPOSITORIES, MIN_SHARE, Z = 5, 3, 0.45, 1.96


def head_comments(text: str) -> Iterator[str]:
    """What the comments of a file's head say, however long it is: all before the first line that is neither comment nor preamble (imports, packages, directives)."""
    block = False
    for line in (m.group() for m in LINE.finditer(text)):
        bare = line.strip()
        opens = bare.startswith(("/*", "<!--")) or bare.startswith(('"""', "'''")) and len(bare) > 2
        if block or opens or bare.startswith(("//", "#", "*", "--", ";", "%")):
            if m := COMMENT_LINE.match(line):
                yield m[1]
        elif bare and not PREAMBLE.match(bare):
            return
        if opens and not bare.endswith(("*/", "-->", '"""', "'''")):
            block = True
        elif block and ("*/" in bare or "-->" in bare or bare.endswith(('"""', "'''"))):
            block = False


def banner(text: str) -> bool:
    """Whether a comment of the head says that a tool made the file; quoted banners and denials do not."""
    return any(FILE_BANNER.search(said) and not NOT_FILE.search(said) for said in (QUOTED.sub(" ", c).strip() for c in head_comments(text)) if said)


def by_hand(text: str) -> bool:
    """Whether a comment of the head says that people wrote the file."""
    return any(BY_HAND.search(QUOTED.sub(" ", c)) for c in head_comments(text))


def foreign_head(path: str, text: str) -> str | None:
    """The other project that the head names as its origin, if any."""
    repository = path.split("/", 1)[0].lower()
    for said in head_comments(text):
        m = OTHER_PROJECT.search(said)
        if m:
            name = next(g for g in m.groups() if g).lower().strip(".-")
            if name not in (repository, repository.replace("-", ""), repository.replace("-", "_")):
                return name
    return None


def minified(path: str, text: str) -> bool:
    """Scripts and style sheets with hardly a line end or a blank in their code."""
    if language(path) not in ("js", "mjs", "cjs", "css", "ts", "jsx") or len(text) < 200:
        return False
    code = re.sub(r"/\*[\s\S]*?\*/|^\s*//[^\n]*", "", text, flags=re.M).strip()
    if len(code) < 150:
        return False
    lines = [x for x in code.split("\n") if x.strip()]
    longest = max(lines, key=len)
    blanks = sum(map(code.count, " \t\n"))
    return len(code) / len(lines) > 110 and len(longest) > 200 and blanks < 0.12 * len(code)


def literal_data(text: str) -> bool:
    """Whether literals fill the file: rows of numbers or strings, with little code around them."""
    if len(text) < 300:
        return False
    rows = other = n = 0
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare[0] in "#*" or bare.startswith(("//", "/*", "--")):
            continue
        if LITERALS.match(bare):
            rows += len(bare)
            n += 1
        elif len(bare) > 200 and (m := re.search(r"[\[({=]\s*([\[({]?\s*[-\d\"'][\s\S]*)$", bare)) and LITERALS.match(m[1]):
            rows += len(m[1])
            other += len(bare) - len(m[1])
            n += 1
        else:
            other += len(bare)
    return rows > 4 * other and rows >= 250


def evidence(path: str | None, text: str | None) -> str | None:
    """What the text gives away: vendored | generated | minified | data, 'by hand' where the head says so, or null."""
    if not path:
        return None
    text = (text or "").lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if not text:
        return None
    if banner(text):
        return "generated"
    if foreign_head(path, text):
        return "vendored"
    if minified(path, text):
        return "minified"
    if literal_data(text):
        return "data"
    return "by hand" if by_hand(text) else None


def path_patterns(path: str) -> list[str]:
    """The patterns a path is an instance of: name endings from a separator or hump on, name beginnings, directories."""
    *dirs, base = path.split("/")[1:] or [path]
    found = {f"**/{d}/**" for d in dirs} | ({"**/" + "/".join(dirs) + "/**"} if len(dirs) > 1 else set())
    dot = base.rfind(".")
    for m in re.finditer(r"[._-](?=\w)|(?<=[a-z0-9])(?=[A-Z])", base):
        if 0 < m.start() < dot:
            found.add("*" + base[m.start() :])
    m = re.match(r"[A-Za-z]+(?:_[a-z]+)?(?=[._-]\w)", base)
    if m and m.end() < dot:
        found.add(m.group() + base[m.end()] + "*" + base[dot:])
    return sorted(found)


# --- attribute files


def attribute_regex(pattern: str) -> str | None:
    """The glob of an attribute file as an anchored regular expression over the path below the file's directory; None if it matches no file.

    ``*``, ``?`` and ``[...]`` stay within a segment; ``**`` is any number of segments where it stands alone in one; a pattern
    without a slash is tried on the base name.  A pattern that ends in a slash names a directory, which has no attributes.
    """
    if pattern.endswith("/") or not pattern:
        return None
    if "/" not in pattern:
        return f"^(?:.*/)?{_segment(pattern)}$"
    segments = pattern.removeprefix("/").split("/")
    out = ""
    for n, segment in enumerate(segments):
        last = n == len(segments) - 1
        if segment == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(segment) + ("" if last else "/")
    return f"^{out}$"


def _segment(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out += "" if out.endswith("[^/]*") else "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and (end := glob.find("]", i + 2 if glob[i : i + 1] in ("!", "^") else i + 1)) > 0:
            members, negated = glob[i:end], glob[i] in "!^"
            members = re.sub(r"([\\\[\]&~^])", r"\\\1", members[1:] if negated else members)
            out += f"[^/{members}]" if negated else f"[{members}]"
            i = end + 1
        else:
            if ch == "\\" and i < len(glob):
                ch, i = glob[i], i + 1
            out += re.escape(ch)
    return out


_ATTRIBUTE_LINE = re.compile(r"\s*(?:\"((?:[^\"\\]|\\.)*)\"|(\S+))((?:\s+\S+)+)\s*$")


def attribute_rules(directory: str, text: str) -> list[tuple[str, int, int, str, str, bool | None]]:
    """(directory, line, place in it, regex, mark, set) of the generated and vendored marks of an attribute file; set is None where it is unspecified."""
    rules, macros = [], {}
    for n, line in enumerate(text.splitlines()):
        m = _ATTRIBUTE_LINE.match(line)
        if not m or line.lstrip().startswith("#"):
            continue
        pattern = m[2] if m[1] is None else re.sub(r"\\(.)", r"\1", m[1])
        said: list[tuple[str, bool | None]] = []
        for attribute in m[3].split():
            name, _, value = attribute.lstrip("-!").partition("=")
            on = None if attribute[0] == "!" else attribute[0] != "-" and value.lower() not in ("false", "0", "no", "off")
            said += [(k, v if on else on) for k, v in macros.get(name, ())] or [(name.rpartition("linguist-")[2], on)]
        if pattern.startswith("[attr]"):
            macros[pattern.removeprefix("[attr]")] = said
            continue
        regex = attribute_regex(pattern)
        if regex:
            rules += [(directory, n, k, regex, mark, on) for k, (mark, on) in enumerate(said) if mark in ("generated", "vendored")]
    return rules


# --- DataFrames

RULE = "directory:string,line:int,place:int,regex:string,mark:string,is_set:boolean"


def judged_texts(texts: DataFrame) -> DataFrame:
    """(path, evidence, rules): what each text shows by itself; rules of attribute files."""
    schema = f"path string, evidence string, rules array<struct<{RULE}>>"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                if path.rsplit("/", 1)[-1] == ".gitattributes":
                    rows.append((path, None, attribute_rules(path.rpartition("/")[0], text or "")))
                else:
                    rows.append((path, evidence(path, text), None))
            yield pd.DataFrame(rows, columns=["path", "evidence", "rules"], dtype=object)

    return texts.filter("path is not null").select("path", "text").mapInPandas(judge, schema)


def repository(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def directories(path: Column) -> Column:
    """Every directory above ``path``, '' included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, said) of the paths on which the attribute rules say something: true if a mark is set, false if marks are unset only."""
    below = paths.select("path", F.explode(directories(F.col("path"))).alias("directory"))
    met = below.join(rules, "directory").withColumn("relative", F.when(F.col("directory") == "", F.col("path")).otherwise(F.expr("substring(path, length(directory) + 2)")))
    last = met.filter(F.expr("relative rlike regex")).groupBy("path", "mark").agg(F.max_by("is_set", F.struct(F.length("directory"), "line", "place")).alias("is_set"))
    return last.filter("is_set is not null").groupBy("path").agg(F.bool_or("is_set").alias("said"))


def exploded(paths: DataFrame) -> DataFrame:
    """``paths`` with one row per pattern of the path."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(pattern=[path_patterns(p) for p in batch["path"]]).explode("pattern").dropna(subset=["pattern"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema.fields)
    return paths.mapInPandas(explode, f"{fields}, pattern string")


def mined_patterns(flagged: DataFrame) -> DataFrame:
    """(pattern, n_files, n_marked) of the patterns that equal a declaration; ``flagged`` is (path, marked)."""
    fine = exploded(flagged).groupBy("pattern", repository(F.col("path")).alias("repository")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("marked").cast("int")).alias("d"))
    counted = fine.groupBy("pattern").agg(F.sum("n").alias("n_files"), F.sum("d").alias("n_marked"), F.count(F.when(F.col("d") > 0, 1)).alias("n_repositories"))
    n, share = F.col("n_files"), F.col("n_marked") / F.col("n_files")
    bound = (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return counted.filter((F.col("n_marked") >= MIN_MARKED) & (F.col("n_repositories") >= MIN_REPOSITORIES) & (bound >= MIN_SHARE)).select("pattern", "n_files", "n_marked")


def states(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, generated, evidence, said, has_rules) of every path, written once."""
    space = Workspace(texts.sparkSession, "handwritten")
    state = newest(files.select("path", "generated", "indexed_at"), "path", [F.col("indexed_at")], ["generated"])
    judged, _ = space.write(judged_texts(texts), "judged")
    rules = judged.filter(F.size("rules") > 0).select(F.explode("rules").alias("rule")).select("rule.*")
    owners = judged.filter(F.size("rules") > 0).select(repository(F.col("path")).alias("repository")).distinct().withColumn("has_rules", F.lit(True))
    every = state.join(judged.select("path", "evidence"), "path", "full_outer").withColumn("repository", repository(F.col("path")))
    said = declared(every.select("path", "repository").join(owners, "repository", "left_semi"), rules)
    every = every.join(owners, "repository", "left").join(said, "path", "left")
    return space.write(every.select("path", "generated", "evidence", "said", F.coalesce("has_rules", F.lit(False)).alias("has_rules")), "states")[0]


def marked(every: DataFrame) -> DataFrame:
    """(path, marked): whether rules, the index or the text itself give a file away."""
    found = F.coalesce(F.col("said"), (F.col("generated") == 1) | F.col("evidence").isin("generated", "vendored", "minified"), F.lit(False))
    return every.select("path", found.alias("marked"))


def patterns_in_use(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, n_files, n_marked): what ``not_handwritten`` mines from these tables."""
    return mined_patterns(marked(states(files, texts)))


def not_handwritten(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, reason) of the files nobody wrote by hand; reason is declared, mined, what the text shows, or named."""
    every = states(files, texts)
    free = every.filter(~F.col("has_rules") & ~F.coalesce(F.col("evidence") == "by hand", F.lit(False))).select("path")
    hits = exploded(free).join(mined_patterns(marked(every)).select("pattern"), "pattern", "left_semi").select("path").distinct().withColumn("mined", F.lit(True))
    base = F.element_at(F.split("path", "/"), -1)
    named = base.rlike(TOOL_NAME) | F.col("path").rlike(VENDOR_DIR)
    reason = (
        F.when(F.col("said"), "declared").when(F.col("said") == F.lit(False), None).when(F.col("generated") == 1, "declared").when(F.col("mined"), "mined")
        .when(F.col("evidence") == "by hand", None).when(F.col("evidence").isNotNull(), F.col("evidence")).when(named, "named")
    )
    return every.join(hits, "path", "left").select("path", reason.alias("reason"), "evidence").filter("reason is not null")
