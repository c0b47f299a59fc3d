"""Recursive descent over kind strings.

A lexer turns a text into one character per token: every keyword and operator of the language has its own,
identifiers are ``i``, numbers ``n``, strings ``s``; line ends stay only where they may end a statement.
What is grammatical depends on kinds alone, so a statement that parsed once is known by its kind string and
is stepped over the next time; this is what makes the parsers fast on large corpora.

Statements are parsed by recursive descent, expressions by precedence climbing.  An error ends the statement
in panic: the parser records it, skips to the next statement end on the same nesting level and goes on.
"""

from __future__ import annotations

import re

MEMO_LIMIT = 200_000
#: Frames that the parsers may stack up; the interpreter keeps those of Python code on the heap.
FRAMES = 400_000
_RUNS = re.compile("\n+")


class Bad(Exception):
    def __init__(self, at: int, message: str):
        self.at, self.message = at, message


class Kinds(dict):
    """Token text -> kind character; texts that are no keyword or operator are classified once and kept."""

    def __init__(self, fixed: dict[str, str], classify):
        super().__init__(fixed)
        self.fixed, self.classify = fixed, classify

    def __missing__(self, token: str) -> str:
        if len(self) > MEMO_LIMIT:
            self.clear()
            self.update(self.fixed)
        self[token] = kind = self.classify(token)
        return kind


def classify(token: str) -> str:
    """i, n, s, or E for a token that no rule of the language allows."""
    first = token[0]
    if token == "_":
        return "i"
    if first.isalpha() or first in "_$@#" and len(token) > 1 or ord(first) > 127 and first.isidentifier():
        last = token[-1]
        return "s" if last in "\"'" and len(token) > 1 else "i"
    if first.isdigit() or first == "." and len(token) > 1 and token[1].isdigit():
        return "n" if re.fullmatch(r"(?:0[xX][\da-fA-F_.pP+-]+|0[bB][01_]+|0[oO][0-7_]+|[\d_]*\.?[\d_]*(?:[eE][+-]?[\d_]+)?)[a-zA-Z]?\w{0,4}", token) else "E"
    if first in "\"'`" and len(token) > 1 and token[-1] == first:
        return "s"
    return "E"


class Grammar:
    """The lexical half of a language."""

    def __init__(self, keywords: str, operators: str, token: str, *, keep_lines: bool = False, enders: str = "", continuers: str = "", classify=classify):
        words = [*keywords.split(), *operators.split()]
        private = (chr(c) for c in range(0xE000, 0xE000 + len(words)))
        self.code = {w: w if len(w) == 1 and not w.isalpha() else next(private) for w in words}
        self.kinds = Kinds(self.code | {"": ""} | ({"\n": "\n"} if keep_lines else {}), classify)
        self.token = re.compile(token)
        self.keep_lines = keep_lines
        if keep_lines:
            ends = "".join(self.code.get(w, w) for w in ("i n s ) ] } " + enders).split())
            goes_on = "".join(self.code.get(w, w) for w in (", ; ) ] } . " + continuers).split())
            self.idle = re.compile(f"(?<![{re.escape(ends)}])\n|\n(?=[{re.escape(goes_on)}\0])")
        self.known: dict[str, set[str]] = {}

    def lex(self, text: str) -> str:
        kinds = "".join(map(self.kinds.__getitem__, self.token.findall(text)))
        return self.idle.sub("", _RUNS.sub("\n", kinds + "\0"))[:-1] if self.keep_lines else kinds

    def chars(self, words: str) -> frozenset[str]:
        return frozenset(self.code.get(w, w) for w in words.split())

    def binary(self, levels: list[str]) -> dict[str, int]:
        """Operator kind -> precedence, the weakest level first."""
        return {self.code.get(op, op): p for p, level in enumerate(levels, 1) for op in level.split()}


class Parser:
    grammar: Grammar
    BINARY: dict[str, int] = {}
    PREFIX: frozenset[str] = frozenset()
    RIGHT: frozenset[str] = frozenset()
    ENDS = ";"
    #: Deepest nesting that is parsed: far beyond what people or tools write, and within FRAMES.
    MAX_DEPTH = 10_000

    def __init__(self, kinds: str):
        self.s, self.i, self.errors = kinds + "\0\0\0", 0, []
        self.c = self.grammar.code
        self.depth = 0

    # --- tools

    def bad(self, wanted: str) -> Bad:
        return Bad(self.i, f"expected {wanted}")

    def at(self, word: str) -> bool:
        return self.s[self.i] == self.c.get(word, word)

    def ahead(self, word: str, n: int = 1) -> bool:
        return self.s[self.i + n] == self.c.get(word, word)

    def take(self, word: str) -> bool:
        if self.s[self.i] == self.c.get(word, word):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if self.s[self.i] != self.c.get(word, word):
            raise self.bad(word if word != "\n" else "a line end")
        self.i += 1

    def ident(self) -> None:
        if self.s[self.i] not in self.IDENT:
            raise self.bad("a name")
        self.i += 1

    def tries(self, rule) -> bool:
        """Applies ``rule``; where it fails, nothing is consumed."""
        start, depth = self.i, self.depth
        try:
            if rule() is not False:
                return True
        except Bad:
            pass
        self.i, self.depth = start, depth
        return False

    def listed(self, item, close: str, sep: str = ",") -> None:
        """Items up to and with ``close``, a trailing separator allowed."""
        while not self.take(close):
            item()
            if not self.take(sep):
                self.need(close)
                return

    # --- statements

    def many(self, rule, close: str, context: str) -> None:
        """``rule`` until ``close`` or the end of the text (not consumed), with panic-mode recovery."""
        known = self.grammar.known.setdefault(context, set())
        simple = self.SIMPLE
        stop = self.c.get(close, close)
        s = self.s
        while True:
            while s[self.i] in "\n":
                self.i += 1
            if s[self.i] == stop or s[self.i] == "\0":
                return
            m = simple.match(s, self.i)
            if m and m.group() in known:
                self.i = m.end()
                continue
            start, depth = self.i, self.depth
            self.depth += 1
            try:
                if self.depth > self.MAX_DEPTH:
                    raise Bad(self.i, "nesting too deep")
                rule()
                if self.i == start:
                    raise self.bad("a statement")
                if m and self.i == m.end() and len(known) < MEMO_LIMIT:
                    known.add(m.group())
            except Bad as e:
                self.errors.append((e.at, e.message))
                self.panic(start)
            self.depth = depth

    def panic(self, start: int) -> None:
        """To the next statement end outside of brackets opened since, at least one token on."""
        self.i = max(self.i, start)
        nesting, first = 0, self.i
        while self.s[self.i] != "\0":
            c = self.s[self.i]
            if c in "({[":
                nesting += 1
            elif c in ")}]":
                nesting -= 1
                if nesting < 0 and self.i > first:
                    return
                if nesting <= 0 and c == "}":
                    self.i += 1
                    return
            elif c in self.ENDS and nesting <= 0:
                self.i += 1
                return
            self.i += 1

    def file(self) -> list[tuple[int, str]]:
        raise NotImplementedError

    # --- expressions

    def expression(self, least: int = 1) -> None:
        self.depth += 1
        if self.depth > self.MAX_DEPTH:
            self.depth -= 1
            raise Bad(self.i, "nesting too deep")
        self.unary()
        while True:
            op = self.s[self.i]
            p = self.BINARY.get(op)
            if p is None or p < least:
                break
            if op == "?":
                if not self.conditional():
                    break
                continue
            self.i += 1
            if op == ">":  # shifts come as single signs, so that type arguments can close one by one
                for _ in range(2):
                    if self.s[self.i] in self.MORE:
                        self.i += 1
            self.operand_after(op, p if op in self.RIGHT else p + 1)
        self.depth -= 1

    MORE = frozenset(">")

    def operand_after(self, op: str, least: int) -> None:
        self.expression(least)

    def conditional(self) -> bool:
        self.need("?")
        self.expression()
        self.need(":")
        self.expression()
        return True

    def unary(self) -> None:
        while self.s[self.i] in self.PREFIX:
            self.i += 1
        self.primary()
        self.postfix()

    def primary(self) -> None:
        raise NotImplementedError

    def postfix(self) -> None:
        raise NotImplementedError


def lines_of(grammar: Grammar, text: str, kinds: str, places: list[int]) -> list[int]:
    """The lines of the tokens behind the kinds at ``places``, in one pass; kept line ends count as kinds, dropped ones do not."""
    lines: dict[int, int] = {}
    open_ = sorted(set(places), reverse=True)
    position, n, line, counted = 0, 0, 1, 0
    dropped = grammar.keep_lines
    for m in grammar.token.finditer(text):
        token = m.group(m.lastindex or 0)
        position = m.end() - len(token)
        kind = grammar.kinds[token]
        if dropped and kind == "\n" and not (n < len(kinds) and kinds[n] == "\n"):
            continue
        if open_ and n >= open_[-1]:
            line, counted = line + text.count("\n", counted, position), position
            while open_ and n >= open_[-1]:
                lines[open_.pop()] = line
        if not open_:
            break
        n += 1
    last = line + text.count("\n", counted, position)
    return [lines.get(at, last) for at in places]
