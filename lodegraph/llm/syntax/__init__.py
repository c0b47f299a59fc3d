"""Parsers that accept or reject source text, by file extension."""

from __future__ import annotations

import ast
import sys
import warnings

from lodegraph.llm.syntax.engine import FRAMES, lines_of
from lodegraph.llm.syntax.indented import Python
from lodegraph.llm.syntax.lines import PARSERS as _PARSERS

#: extension -> parser
PARSERS = _PARSERS | {"py": Python, "pyi": Python}
#: extension -> language name in reports
LANGUAGES = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "c": "c", "go": "go", "rs": "rust", "rb": "ruby", "py": "python", "pyi": "python"}


def errors(ext: str, text: str) -> list[tuple[int, str]]:
    """(line, message) of every syntax error, the first cause first; empty for valid, empty and comment-only texts.

    A text too deeply nested to be parsed to its end has that as its last error.
    """
    parser = PARSERS[ext]
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    source = parser.prepare(text)
    kinds = parser.grammar.lex(source)
    if not kinds.strip("\n;"):
        return []
    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
    run = parser(kinds)
    try:
        found = run.file()
    except RecursionError:
        found = [*run.errors, (run.i, "nesting too deep to parse")]
    if found and parser is Python and _valid_python(text):
        return []
    return list(zip(lines_of(parser.grammar, source, kinds, [at for at, _ in found]), [message for _, message in found]))


def _valid_python(text: str) -> bool:
    """The exact check behind the parser: what the interpreter itself accepts is no error."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
