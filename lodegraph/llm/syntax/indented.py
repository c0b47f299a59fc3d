"""Statements and expressions of Python."""

from __future__ import annotations

import re

from lodegraph.llm.syntax.engine import Bad, Grammar, Parser, classify

_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type"
_OPS = "( ) { } [ ] ; , . : = + - * / % < > & | ^ ~ @ ! == != <= >= += -= *= /= //= %= &= |= ^= <<= >>= **= @= << >> ** // := -> ..."
_LONG = r"[rbuRBUfFtT]{0,2}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
_TOKEN = r"(?:[ \t\f﻿]+|\\\n|#[^\n]*)*+(\n[ \t\f]*(?:(?:#[^\n]*)?\n[ \t\f]*)*+(?:#[^\n]*\Z)?|" + _LONG + r"|[^\W\d]\w*|\.?\d(?:[eE][+-]|[\w.])*|\.\.\.|->|:=|\*\*=?|//=?|<<=?|>>=?|[=!<>+\-*/%&|^@]=|\S|\Z)"
INDENT, DEDENT = "\x01", "\x02"


def _kind(token: str) -> str:
    if token[0] == "\n":
        last = token[token.rfind("\n") + 1 :]
        return "" if last.lstrip(" \t\f")[:1] == "#" else chr(0xF000 + min(2000, len(last.replace("\f", "").expandtabs(8))))
    if token[0] in "rbuRBUfFtT" and token[-1] in "\"'" and ('"' in token or "'" in token):
        return "s"
    return "n" if re.fullmatch(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[jJ]?)", token) else classify(token) if not token[0].isdigit() else "E"


class _Lines(Grammar):
    """Line ends as they stand become NEWLINE, INDENT and DEDENT, or nothing inside brackets."""

    marks = re.compile("[()\\[\\]{}-]")

    def lex(self, text: str) -> str:
        kinds = "".join(map(self.kinds.__getitem__, self.token.findall("\n" + text)))
        out, at, depth, levels, first = [], 0, 0, [0], True
        for m in self.marks.finditer(kinds):
            k = m.group()
            if k in "([{":
                depth += 1
            elif k in ")]}":
                depth = max(0, depth - 1)
            else:
                out.append(kinds[at : m.start()])
                at = m.end()
                if depth:
                    continue
                width = ord(k) - 0xF000
                if at == len(kinds):
                    width = 0
                if not first:
                    out.append("\n")
                first = False
                if width > levels[-1]:
                    levels.append(width)
                    out.append(INDENT)
                while width < levels[-1]:
                    levels.pop()
                    out.append(DEDENT)
                    if width > levels[-1]:
                        out.append("E")
                        levels.append(width)
                        break
        out.append(kinds[at:])
        body = "".join(out)
        return body + ("\n" if body and body[-1] not in "\n\x02" else "") + DEDENT * (len(levels) - 1)


PYTHON = _Lines(_WORDS, _OPS, _TOKEN, classify=_kind)


class Python(Parser):
    grammar = PYTHON
    ENDS = "\n"
    MAX_DEPTH = 200  # as the interpreter's own parser
    SIMPLE = re.compile("[^:\n\0\x01\x02]*\n")
    IDENT = PYTHON.chars("i match case type")
    BINARY = PYTHON.binary(["or", "and", "in is not < > == != <= >=", "|", "^", "&", "<< >>", "+ -", "* / % // @", "**"])
    RIGHT = PYTHON.chars("**")
    PREFIX = PYTHON.chars("+ - ~ not await")
    AUGMENTED = PYTHON.chars("+= -= *= /= //= %= &= |= ^= <<= >>= **= @=")
    MORE = frozenset()

    @staticmethod
    def prepare(text: str) -> str:
        return text

    def file(self):
        while True:
            self.many(self.statement, "\0", "statement")
            if self.s[self.i] == "\0":
                return self.errors

    def panic(self, start: int) -> None:
        self.i = max(self.i, start)
        end = self.s.find("\n", self.i)
        self.i = len(self.s) - 3 if end < 0 else end + 1
        while self.s[self.i] in (INDENT, DEDENT):
            self.i += 1

    def suite(self) -> None:
        self.need(":")
        if not self.take("\n"):
            return self.simple_line()
        self.need(INDENT)
        self.many(self.statement, DEDENT, "statement")
        self.need(DEDENT)

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take(";"):
                break
            if self.at("\n"):
                break
        self.need("\n")

    def statement(self) -> None:
        c, k = self.c, self.s[self.i]
        if k == c["if"] or k == c["while"]:
            self.i += 1
            self.named()
            self.suite()
            while k == c["if"] and self.take("elif"):
                self.named()
                self.suite()
            if self.take("else"):
                self.suite()
        elif k == c["for"]:
            self.loop()
        elif k == c["try"]:
            self.i += 1
            self.suite()
            handled = False
            while self.take("except"):
                handled = True
                self.take("*")
                if not self.at(":"):
                    self.expression()
                    while self.take(","):
                        self.expression()
                    if self.take("as"):
                        self.ident()
                self.suite()
            if handled and self.take("else"):
                self.suite()
            if self.take("finally"):
                self.suite()
            elif not handled:
                raise self.bad("except or finally")
        elif k == c["with"]:
            self.with_()
        elif k == c["def"]:
            self.function()
        elif k == c["class"]:
            self.i += 1
            self.ident()
            self.type_parameters()
            if self.take("("):
                self.arguments()
            self.suite()
        elif k == c["async"]:
            self.i += 1
            if self.at("def"):
                self.function()
            elif self.at("for"):
                self.loop()
            else:
                self.with_()
        elif k == "@":
            self.i += 1
            self.named()
            self.need("\n")
            if not (self.at("@") or self.at("def") or self.at("class") or self.at("async")):
                raise self.bad("def or class")
            self.statement()
        elif k == c["match"] and self.tries(self.match_head):
            self.many(self.case, DEDENT, "case")
            self.need(DEDENT)
        else:
            self.simple_line()

    def match_head(self) -> None:
        self.need("match")
        self.starred_list()
        self.need(":")
        self.need("\n")
        self.need(INDENT)
        if not self.at("case"):
            raise self.bad("case")

    def case(self) -> None:
        self.need("case")
        self.pattern()
        while self.take(","):
            if not self.at(":") and not self.at("if"):
                self.pattern()
        if self.take("if"):
            self.named()
        self.suite()

    def pattern(self) -> None:
        if self.take("*") or self.take("**"):
            self.ident()
        else:
            self.expression()
        if self.take("as"):
            self.ident()

    def loop(self) -> None:
        self.need("for")
        self.targets()
        self.need("in")
        self.starred_list()
        self.suite()
        if self.take("else"):
            self.suite()

    def with_(self) -> None:
        self.need("with")
        if not self.tries(self.with_parens):
            self.with_item()
            while self.take(","):
                self.with_item()
        self.suite()

    def with_parens(self) -> None:
        self.need("(")
        self.listed(self.with_item, ")")
        if not self.at(":"):
            raise self.bad(":")

    def with_item(self) -> None:
        self.expression()
        if self.take("as"):
            self.target()

    def function(self) -> None:
        self.need("def")
        self.ident()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        if self.take("->"):
            self.expression()
        self.suite()

    def type_parameters(self) -> None:
        if self.take("["):
            while not self.take("]"):
                self.take("*") or self.take("**")
                self.ident()
                if self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                if not self.take(","):
                    self.need("]")
                    break

    def parameters(self, close: str, annotated: bool) -> None:
        while not self.take(close):
            if self.take("/"):
                pass
            elif self.take("*"):
                if not self.at(","):
                    self.ident()
            else:
                self.take("**")
                self.ident()
            if annotated and self.take(":"):
                self.take("*")
                self.expression()
            if self.take("="):
                self.expression()
            if not self.take(","):
                self.need(close)
                return

    def simple(self) -> None:
        c, k = self.c, self.s[self.i]
        if k in (c["pass"], c["break"], c["continue"]):
            self.i += 1
        elif k == c["return"]:
            self.i += 1
            if self.s[self.i] not in "\n;":
                self.starred_list()
        elif k == c["raise"]:
            self.i += 1
            if self.s[self.i] not in "\n;":
                self.expression()
                if self.take("from"):
                    self.expression()
        elif k in (c["global"], c["nonlocal"]):
            self.i += 1
            self.ident()
            while self.take(","):
                self.ident()
        elif k == c["del"]:
            self.i += 1
            self.targets()
        elif k == c["assert"]:
            self.i += 1
            self.expression()
            if self.take(","):
                self.expression()
        elif k == c["import"]:
            self.i += 1
            self.module()
            while self.take(","):
                self.module()
        elif k == c["from"]:
            self.i += 1
            dots = False
            while self.take(".") or self.take("..."):
                dots = True
            if not (dots and self.at("import")):
                self.dotted()
            self.need("import")
            if self.take("*"):
                return
            if self.take("("):
                self.listed(self.imported, ")")
            else:
                self.imported()
                while self.take(","):
                    self.imported()
        elif k == c["type"] and self.s[self.i + 1] in self.IDENT:
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.expression()
        else:
            self.value()
            if self.take(":"):
                self.expression()
                if self.take("="):
                    self.value()
            elif self.s[self.i] in self.AUGMENTED:
                self.i += 1
                self.value()
            else:
                while self.take("="):
                    self.value()

    def value(self) -> None:
        if self.at("yield"):
            self.yields()
        else:
            self.starred_list()

    def yields(self) -> None:
        self.need("yield")
        if self.take("from"):
            self.expression()
        elif self.s[self.i] not in "\n;)=]}":
            self.starred_list()

    def dotted(self) -> None:
        self.ident()
        while self.take("."):
            self.ident()

    def module(self) -> None:
        self.dotted()
        if self.take("as"):
            self.ident()

    def imported(self) -> None:
        self.ident()
        if self.take("as"):
            self.ident()

    def target(self) -> None:
        self.take("*")
        self.expression(4)

    def targets(self) -> None:
        self.target()
        while self.take(","):
            if self.at("in") or self.s[self.i] in "\n;":
                break
            self.target()

    def starred_list(self) -> None:
        self.starred()
        while self.take(","):
            if self.s[self.i] in "\n;:=)]}" or self.s[self.i] in self.AUGMENTED:
                break
            self.starred()

    def starred(self) -> None:
        if self.take("*"):
            self.expression(4)
        else:
            self.named()

    def named(self) -> None:
        self.expression()
        if self.take(":="):
            self.expression()

    def expression(self, least: int = 1) -> None:
        if self.at("lambda"):
            self.i += 1
            self.parameters(":", False)
            return self.expression()
        super().expression(least)
        if least == 1 and self.at("if"):
            self.i += 1
            super().expression(1)
            self.need("else")
            self.expression()

    def operand_after(self, op: str, least: int) -> None:
        if op == self.c["not"]:
            self.need("in")
        elif op == self.c["is"]:
            self.take("not")
        if self.at("lambda"):
            return self.expression()
        super().expression(least)

    def primary(self) -> None:
        c, k = self.c, self.s[self.i]
        if k in self.IDENT or k in (c["None"], c["True"], c["False"], c["..."]) or k == "n":
            self.i += 1
        elif k == "s":
            while self.take("s"):
                pass
        elif k == "(":
            self.i += 1
            if self.at("yield"):
                self.yields()
                self.need(")")
            else:
                self.elements(")")
        elif k == "[":
            self.i += 1
            self.elements("]")
        elif k == "{":
            self.i += 1
            self.braces()
        else:
            raise self.bad("an expression")

    def elements(self, close: str) -> None:
        first = True
        while not self.take(close):
            self.starred()
            if first and self.comprehension(close):
                return
            first = False
            if not self.take(","):
                self.need(close)
                return

    def comprehension(self, close: str) -> bool:
        if not (self.at("for") or self.at("async")):
            return False
        while self.take("for") or self.take("async") and self.take("for"):
            self.targets()
            self.need("in")
            super().expression(1)
            while self.take("if"):
                super().expression(1)
                if self.take(":="):
                    self.expression()
        self.need(close)
        return True

    def braces(self) -> None:
        first = True
        while not self.take("}"):
            if self.take("**"):
                self.expression(4)
            else:
                self.starred()
                if self.take(":"):
                    self.expression()
                if first and self.comprehension("}"):
                    return
            first = False
            if not self.take(","):
                self.need("}")
                return

    def arguments(self) -> None:
        """After the opening parenthesis."""
        while not self.take(")"):
            if self.take("*") or self.take("**"):
                self.expression()
            elif self.s[self.i] in self.IDENT and self.ahead("="):
                self.i += 2
                self.expression()
            else:
                self.named()
                if self.comprehension(")"):
                    return
            if not self.take(","):
                self.need(")")
                return

    def postfix(self) -> None:
        while True:
            if self.take("("):
                self.arguments()
            elif self.take("["):
                while not self.take("]"):
                    if not self.at(":"):
                        self.starred()
                    while self.take(":"):
                        if self.s[self.i] not in ":,]":
                            self.expression()
                    if not self.take(","):
                        self.need("]")
                        break
            elif self.take("."):
                self.ident()
            else:
                return
