"""Source texts to nodes, containment edges and unresolved references.

One pass per file where it is read.  Python goes through the interpreter's own syntax tree, other languages
through declaration patterns and brace depth; a language without an extractor yields its file node only.  Files
that do not parse yield what could be read.  Ids are those of the store: kind and a hash of path, kind, name, line.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ROWS = "what string, id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, parent_id string, reference_name string, reference_kind string"


def symbol_id(path: str, kind: str, name: str, line: int) -> str:
    if kind == "file":
        return f"file:{path}"
    return f"{kind}:{hashlib.sha256(f'{path}:{kind}:{name}:{line}'.encode()).hexdigest()[:32]}"


def _row(what, **values):
    return {c.split()[0]: None for c in ROWS.split(", ")} | {"what": what} | values


def python_rows(path: str, text: str) -> Iterator[dict]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return
    stack = [(tree, symbol_id(path, "file", path, 1), "", False)]
    while stack:
        node, parent, prefix, in_class = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                own = symbol_id(path, kind, child.name, child.lineno)
                qualified = f"{prefix}::{child.name}" if prefix else child.name
                yield _row("node", id=own, kind=kind, name=child.name, qualified_name=qualified, file_path=path, start_line=child.lineno, end_line=child.end_lineno, parent_id=parent)
                for base in getattr(child, "bases", []):
                    yield _row("ref", parent_id=own, file_path=path, start_line=child.lineno, reference_name=ast.unparse(base), reference_kind="extends")
                for mark in child.decorator_list:
                    yield _row("ref", parent_id=own, file_path=path, start_line=mark.lineno, reference_name=ast.unparse(mark).split("(")[0], reference_kind="decorates")
                stack.append((child, own, qualified, kind == "class"))
                continue
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                module = getattr(child, "module", None) or ""
                for alias in child.names:
                    name = f"{module}/{alias.name}" if module else alias.name
                    yield _row("node", id=symbol_id(path, "import", alias.name, child.lineno), kind="import", name=alias.name, qualified_name=name, file_path=path, start_line=child.lineno, end_line=child.lineno, parent_id=parent)
            elif isinstance(child, ast.Call):
                try:
                    yield _row("ref", parent_id=parent, file_path=path, start_line=child.lineno, reference_name=ast.unparse(child.func), reference_kind="calls")
                except RecursionError:
                    pass
            stack.append((child, parent, prefix, in_class))


_WATER = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`(?:[^`\\]|\\.)*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_DECLARED = re.compile(
    r"^[ \t]*(?:(?:export|default|public|private|protected|static|abstract|final|async|pub(?:\([^)]*\))?|unsafe|const|declare)[ \t]+)*(?P<word>class|interface|struct|enum|trait|namespace|module|impl|func|fn|function|type)\b[ \t]*\*?[ \t]*(?:\([^)\n]*\)[ \t]*)?(?P<name>[A-Za-z_$][\w$]*)", re.M)
_KIND = {"func": "function", "fn": "function", "function": "function", "class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait", "namespace": "namespace", "module": "module", "type": "type_alias"}
_IMPORTED = re.compile(r"^[ \t]*(?:import|use|require|from|#include|package)\b[ \t(]*([^\n;]+)", re.M)
_CALLED = re.compile(r"(?<![\w.])([A-Za-z_$][\w$.]*)\s*\(")
_NOT_CALLED = frozenset("if for while switch catch return function func fn class sizeof super match and or not new await typeof".split())


def braced_rows(path: str, text: str) -> Iterator[dict]:
    blank = _WATER.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    marks = sorted([(m.start("name"), "head", m) for m in _DECLARED.finditer(blank)] + [(m.start(), m.group(), None) for m in re.finditer(r"[{}]", blank)], key=lambda x: x[0])
    line_at = [0, 1]

    def line(position: int) -> int:
        line_at[1] += blank.count("\n", line_at[0], position)
        line_at[0] = position
        return line_at[1]

    file_id = symbol_id(path, "file", path, 1)
    open_: list[list] = []
    depth, waiting = 0, None
    for position, mark, m in marks:
        if mark == "head":
            if m["word"] in _KIND:
                waiting = (m["name"], _KIND[m["word"]], line(position))
        elif mark == "{":
            depth += 1
            if waiting:
                name, kind, at = waiting
                parent = open_[-1] if open_ else None
                if kind == "function" and parent and parent[1] in ("class", "struct", "trait", "interface"):
                    kind = "method"
                qualified = f"{parent[3]}::{name}" if parent else name
                open_.append([name, kind, at, qualified, symbol_id(path, kind, name, at), parent[4] if parent else file_id, depth])
                waiting = None
        else:
            if open_ and open_[-1][6] == depth:
                name, kind, at, qualified, own, parent_id, _ = open_.pop()
                yield _row("node", id=own, kind=kind, name=name, qualified_name=qualified, file_path=path, start_line=at, end_line=line(position), parent_id=parent_id)
            depth = max(0, depth - 1)
    for m in _IMPORTED.finditer(blank if not path.endswith((".ts", ".js", ".mjs", ".go", ".rb")) else text):
        name = m[1].strip().strip("\"'<>();").split(" as ")[0]
        at = text.count("\n", 0, m.start()) + 1
        yield _row("node", id=symbol_id(path, "import", name, at), kind="import", name=name, qualified_name=name, file_path=path, start_line=at, end_line=at, parent_id=file_id)
    for m in _CALLED.finditer(blank):
        if m[1] not in _NOT_CALLED:
            yield _row("ref", parent_id=file_id, file_path=path, start_line=blank.count("\n", 0, m.start()) + 1, reference_name=m[1], reference_kind="calls")


#: extension -> extractor; further languages register here.
EXTRACTORS: dict[str, Callable[[str, str], Iterator[dict]]] = {"py": python_rows, **dict.fromkeys(("ts", "js", "mjs", "go", "rs", "java", "c"), braced_rows)}


def register(extension: str, extractor: Callable[[str, str], Iterator[dict]]) -> None:
    """Adds a language: ``extractor(path, text)`` yields rows as ``node_row`` and ``ref_row`` make them."""
    EXTRACTORS[extension.lower().lstrip(".")] = extractor


def node_row(path: str, kind: str, name: str, start_line: int, end_line: int, parent_id: str | None = None, qualified_name: str | None = None) -> dict:
    """A symbol; without a parent it stands in the file."""
    parent = parent_id or symbol_id(path, "file", path, 1)
    return _row("node", id=symbol_id(path, kind, name, start_line), kind=kind, name=name, qualified_name=qualified_name or name, file_path=path, start_line=start_line, end_line=end_line, parent_id=parent)


def ref_row(path: str, name: str, kind: str, line: int, from_id: str | None = None) -> dict:
    """A reference, from the file itself where no symbol holds it."""
    return _row("ref", parent_id=from_id or symbol_id(path, "file", path, 1), file_path=path, start_line=line, reference_name=name, reference_kind=kind)


def extract(texts: DataFrame) -> DataFrame:
    """Rows of (path, text) as ``ROWS``: what is 'node' (parent_id is the container) or 'ref' (parent_id is the source)."""

    extractors = dict(EXTRACTORS)  # goes with the plan, registered languages included

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(batch["path"], batch["text"]):
                rows.append(_row("node", id=symbol_id(path, "file", path, 1), kind="file", name=path.rsplit("/", 1)[-1], qualified_name=path, file_path=path, start_line=1, end_line=(text or "").count("\n") + 1))
                extractor = extractors.get(path.rsplit(".", 1)[-1].lower())
                if extractor and text:
                    rows.extend(extractor(path, text.replace("\r\n", "\n")))
            yield pd.DataFrame(rows, columns=columns).astype({"start_line": "Int32", "end_line": "Int32"})

    return texts.filter("path is not null").select("path", "text").mapInPandas(run, ROWS)


def without_comments(text: str | None, path: str) -> str | None:
    """``text`` with comments blanked; every offset and line stays."""
    if text is None:
        return None
    hash_style = path.endswith((".py", ".rb", ".sh", ".yaml", ".yml"))
    pattern = r"(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(#[^\n]*)" if hash_style else r"(`(?:[^`\\]|\\.)*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
    return re.sub(pattern, lambda m: m.group() if m[1] is not None else re.sub(r"[^\n]", " ", m.group()), text)
