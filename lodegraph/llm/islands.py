"""Island grammars: functions with their documentation, annotations, signature and balanced body.

Per language family the grammar knows only what an island needs: comments and strings (so that braces
in them do not count), annotations, function heads, and how a body closes (braces, indentation or
``end``).  All other code is water and is stepped over by one regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Island(NamedTuple):
    name: str
    start_line: int
    end_line: int
    doc: str
    signature: str
    code: str


_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"
_NOT_HEADS = r"(?:if|for|while|switch|catch|return|else|do|try|new|throw|typeof|await|sizeof|synchronized|with|super|this|function|delete|in|of|case)\b"
_WATER = {
    "brace": r"(?P<comment>(?://[^\n]*(?:\n[ \t]*(?=//))?)+|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>" + _STRINGS + r")|(?P<open>\{)|(?P<close>\})|(?P<end>;)",
    "tick": r"(?P<comment>(?://[^\n]*(?:\n[ \t]*(?=//))?)+|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>`(?:[^`\\]|\\.)*`?|" + _STRINGS + r")|(?P<open>\{)|(?P<close>\})|(?P<end>;)",
    "rust": r"(?P<comment>(?://[^\n]*(?:\n[ \t]*(?=//))?)+|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>r#*\"[\s\S]*?\"#*|\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\\n]|\\.[^'\n]{0,8})')|(?P<open>\{)|(?P<close>\})|(?P<end>;)",
}
_HEADS = {
    "go": r"^func\b[ \t]*(?:\([^)\n]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\])?\([^{;]*?(?=\{|$)",
    "rust": r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"\n]*\")?)[ \t]+)*fn[ \t]+(?P<name>\w+)[^{;]*",
    "js": r"^[ \t]*(?:(?:export|default|public|private|protected|static|async|abstract|override|readonly|get|set|declare)[ \t]+)*(?:function\b[ \t]*\*?[ \t]*)?(?!" + _NOT_HEADS + r")(?P<name>[#\w$]+)[ \t]*(?:<[^>\n]*>)?\([^{};]*?\)[ \t]*(?::[^{};\n]+)?(?=\{)"
    r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name2>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]*)?(?:function\b[^{;]*|\([^{};\n]*\)[^{};\n]*=>[ \t]*|[\w$]+[ \t]*=>[ \t]*)(?=\{)",
    "java": r"^[ \t]*(?!" + _NOT_HEADS + r")(?:[\w<>\[\],.?&]+[ \t]+|\*[ \t]*)+\**(?P<name>\w+)[ \t]*\([^{};]*\)[^{};=]*(?=\{)|^[ \t]*(?:public|private|protected)[ \t]+(?P<name2>\w+)[ \t]*\([^{};]*\)[^{};=]*(?=\{)",
}
_FAMILY = {
    "go": ("tick", "go"), "rs": ("rust", "rust"), "java": ("brace", "java"), "c": ("brace", "java"), "h": ("brace", "java"), "cc": ("brace", "java"), "cpp": ("brace", "java"), "hpp": ("brace", "java"), "cs": ("brace", "java"),
    **dict.fromkeys(("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), ("tick", "js")),
}
_BRACED = {pair: re.compile(_WATER[pair[0]] + "|(?P<head>" + _HEADS[pair[1]] + ")", re.M) for pair in set(_FAMILY.values())}
# Annotations between documentation and head; possessive, so that one pass decides however many there are.
_ANNOTATION = re.compile(r"(?:\s*+(?:@[\w.]++(?:\s*+\((?:[^()]|\([^()]*\))*+\))?+|#!?\[[^\]\n]*+\]))*+\s*+\Z")
_PY = re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)")
_RB = re.compile(r"^(?P<indent>[ \t]*)def[ \t]+(?:self\.)?(?P<name>[\w]+[?!=]?)")
_PY_LONG = re.compile(r"(?P<long>[rbuRBUfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)))|#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?")
_RB_LONG = re.compile(r"^=begin[\s\S]*?(?:^=end[^\n]*|\Z)", re.M)


def language(path: str | None) -> str:
    """The extension that names the language, '' if there is none."""
    return path.rpartition("/")[2].rpartition(".")[2].lower() if path and "." in path.rpartition("/")[2] else ""


_OPENING, _CLOSING = "([{<", ")]}>"
_NAME = re.compile(r"[^\W\d]\w*|\$\w+")
#: Languages that write the parameter's name after its type.
_NAME_LAST = frozenset("java c cpp cc h hpp csharp cs objc cuda dart".split())


def _groups(text: str, start: int) -> list[str]:
    """The top-level parts between commas of the parenthesis that opens at ``start``."""
    parts, depth, begin = [], 0, start + 1
    for i in range(start, len(text)):
        ch = text[i]
        if ch in _OPENING:
            depth += 1
        elif ch in _CLOSING and not (ch == ">" and text[i - 1] in "-="):
            depth -= 1
            if not depth:
                return [*parts, text[begin:i]]
        elif ch == "," and depth == 1:
            parts.append(text[begin:i])
            begin = i + 1
    return [*parts, text[begin:]]


def parameters(signature: str | None, name: str | None, language_name: str | None) -> list[str]:
    """The parameter names in a signature: the parenthesis after the function's name, else the first one.

    Types, defaults, annotations and return types are skipped water; of a destructured parameter all names count.
    """
    if not signature or "(" not in signature:
        return []
    head = re.search(rf"\b{re.escape(name)}\s*(?:<[^()]*>|\[[^()]*\])?\s*\(", signature) if name else None
    found = []
    for part in _groups(signature, head.end() - 1 if head else signature.index("(")):
        part = re.sub(r"@\w+(?:\([^()]*\))?", " ", part).strip()
        if part.startswith(("{", "[")):
            found += _NAME.findall(part.split("}")[0].split("]")[0])
            continue
        part = re.split(r"(?<![=<>!])=(?![=>])", part)[0]
        if ":" in part:
            names = _NAME.findall(part.split(":")[0])[-1:]
        elif language_name in _NAME_LAST:
            names = _NAME.findall(re.sub(r"<[^<>]*>|\[[^\]]*\]", " ", part))[-1:]
        else:
            names = _NAME.findall(part)[:1]
        found += names
    return found


def islands(path: str | None, text: str | None) -> Iterator[Island]:
    """The functions of a file in the order in which they close; nothing for unknown languages or null texts."""
    ext = language(path)
    if not text:
        return iter(())
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if ext in _FAMILY:
        return _braced(_BRACED[_FAMILY[ext]], text)
    if ext in ("py", "pyi"):
        return _indented(text)
    return _ended(text) if ext == "rb" else iter(())


def _braced(grammar: re.Pattern, text: str) -> Iterator[Island]:
    depth, line, at = 0, 1, 0
    doc = (0, 0)
    pending: tuple | None = None
    open_heads: list[tuple] = []
    for m in grammar.finditer(text):
        kind = m.lastgroup
        if kind == "string":
            continue
        if kind == "comment":
            doc = m.span()
        elif kind == "open":
            depth += 1
            if pending:
                open_heads.append((*pending, depth, m.start()))
                pending = None
        elif kind == "close":
            if open_heads and open_heads[-1][-2] == depth:
                name, begin, documentation, _, body = open_heads.pop()
                line += text.count("\n", at, begin) if begin >= at else -text.count("\n", begin, at)
                at = begin
                yield Island(name, line, line + text.count("\n", begin, m.end()), documentation, " ".join(text[begin:body].split()), text[begin : m.end()])
            depth = max(0, depth - 1)
        elif kind == "end":
            pending = None
        else:
            begin = m.end() - len(m.group().lstrip())
            near = _ANNOTATION.match(text, doc[1], begin) if doc[1] else None
            pending = (m.group("name") or m.groupdict().get("name2"), begin, text[doc[0] : doc[1]] if near else "")


def _unbroken(pattern: re.Pattern, text: str) -> str:
    """``text`` with the line ends inside long strings replaced, so that lines are lines of code."""
    return pattern.sub(lambda m: m.group().replace("\n", "\0"), text)


def _indented(text: str) -> Iterator[Island]:
    def close(function: tuple, last: int) -> Island:
        _, name, number, start, end_of_head = function
        first = lines[end_of_head].strip().replace("\0", "\n") if end_of_head < len(lines) else ""
        documentation = first if re.match(r"[rRuU]?(?:\"|')", first) else "\n".join(comments.get(start, ()))
        spanned = text_lines[number : numbers[last][1]]
        return Island(name, number + 1, numbers[last][1], documentation, " ".join(" ".join(lines[start:end_of_head]).split()), "\n".join(spanned))

    lines = _unbroken(_PY_LONG, text).split("\n") if '"""' in text or "'''" in text else text.split("\n")
    text_lines = text.split("\n")
    numbers, count = [], 0
    for line in lines:
        more = 1 + line.count("\0")
        numbers.append((count, count + more))
        count += more
    comments: dict[int, list[str]] = {}
    stack: list[tuple] = []
    last, above, n = 0, [], 0
    while n < len(lines):
        line = lines[n]
        code = line.lstrip()
        if not code:
            above = []
        elif code[0] == "#":
            above.append(code)
        else:
            indent = len(line) - len(code)
            while stack and indent <= stack[-1][0]:
                yield close(stack.pop(), last)
            if code[0] == "d" or code[0] == "a":
                m = _PY.match(line)
                if m:
                    comments[n] = above
                    end, open_ = n, line.count("(") - line.count(")")
                    while open_ > 0 and end + 1 < len(lines):
                        end += 1
                        open_ += lines[end].count("(") - lines[end].count(")")
                    stack.append((indent, m["name"], numbers[n][0], n, end + 1))
                    n = last = end
            if code[0] != "@":
                above = []
            last = n
        n += 1
    while stack:
        yield close(stack.pop(), last)


def _ended(text: str) -> Iterator[Island]:
    lines = _unbroken(_RB_LONG, text).split("\n") if "=begin" in text else text.split("\n")
    stack: list[tuple] = []
    above: list[str] = []
    number = 0
    for line in lines:
        code = line.lstrip()
        if code.startswith("#") or line.startswith("=begin"):
            above.append(code.replace("\0", "\n"))
        else:
            indent = len(line) - len(code)
            for f in stack:
                f[-1].append(line)
            if code[:3] == "end" and not code[3:4].isalnum():
                while stack and stack[-1][0] >= indent:
                    opened, name, start, documentation, spanned = stack.pop()
                    if opened == indent:
                        yield Island(name, start, number + 1, documentation, spanned[0].strip(), "\n".join(spanned))
            elif code[:4] == "def " and (m := _RB.match(line)):
                stack.append((indent, m["name"], number + 1, "\n".join(above), [line]))
            above = []
        number += 1 + line.count("\0")
