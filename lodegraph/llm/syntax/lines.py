"""Statements and expressions of Go, Rust, Ruby and Python."""

from __future__ import annotations

import re

from lodegraph.llm.syntax.curly import _NUMBER, _OPERATORS, _SKIP, _STRING, C, Java, Script, Typed
from lodegraph.llm.syntax.engine import Bad, Grammar, Parser, classify

_GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_GO_OPS = _OPERATORS + " := <- &^ &^="
_GO_TOKEN = _SKIP + r")*+(\n|[^\W\d]\w*|" + _NUMBER + r"|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.[^'\n]*)'|\.\.\.|:=|<-|&\^=?|\+\+|--|&&|\|\||[=!]=|<<=?|<=|>=|[-+*/%&|^]=|\S|\Z)"
GO = Grammar(_GO_WORDS, _GO_OPS, _GO_TOKEN, keep_lines=True, enders="break continue fallthrough return ++ --", continuers="")
GO.idle = re.compile("(?<![ins)\\]}" + "".join(GO.code[w] for w in ("break", "continue", "fallthrough", "return", "++", "--")) + "])\n|\n(?=[)}])")


class Go(Parser):
    grammar = GO
    ENDS = ";\n"
    SIMPLE = re.compile("[^;{}\n\0]*[;\n]")
    IDENT = frozenset("i")
    BINARY = GO.binary(["||", "&&", "== != < <= > >=", "+ - | ^", "* / % << & &^"])
    PREFIX = GO.chars("+ - ! ^ * & <-")
    ASSIGN = GO.chars("= := += -= *= /= %= &= |= ^= <<= &^= >=")
    MORE = GO.chars(">")
    literals = True

    @staticmethod
    def prepare(text: str) -> str:
        return text

    def file(self):
        while self.s[self.i] in "\n;":
            self.i += 1
        try:
            self.need("package")
            self.ident()
            self.end()
        except Bad as e:
            self.errors.append((e.at, e.message))
        while True:
            self.many(self.top, "\0", "top")
            if self.s[self.i] == "\0":
                return self.errors

    def end(self) -> None:
        if self.s[self.i] in ";\n":
            self.i += 1
        elif self.s[self.i] not in ")}\0":
            raise self.bad("the end of the statement")

    def top(self) -> None:
        c, k = self.c, self.s[self.i]
        if k == ";":
            self.i += 1
        elif k == c["import"]:
            self.i += 1
            self.group(self.import_spec)
            self.end()
        elif k == c["func"]:
            self.i += 1
            if self.at("("):
                self.parameters()
            self.ident()
            if self.at("["):
                self.i += 1
                self.listed(self.type_parameter, "]")
            self.signature()
            if self.at("{"):
                self.block()
            self.end()
        elif not self.declaration():
            raise self.bad("a declaration")

    def declaration(self) -> bool:
        c, k = self.c, self.s[self.i]
        if k not in (c["var"], c["const"], c["type"]):
            return False
        self.i += 1
        self.group(self.type_spec if k == c["type"] else self.value_spec)
        self.end()
        return True

    def group(self, spec) -> None:
        if self.take("("):
            while not self.take(")"):
                if self.s[self.i] in ";\n":
                    self.i += 1
                    continue
                spec()
                if not self.at(")"):
                    self.end()
        else:
            spec()

    def import_spec(self) -> None:
        self.take("i") or self.take(".")
        self.need("s")

    def value_spec(self) -> None:
        self.ident()
        while self.take(","):
            self.ident()
        if not self.at("=") and self.s[self.i] not in ";\n)":
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.ident()
        if self.at("[") and self.s[self.i + 1] == "i" and self.s[self.i + 2] not in "]":
            self.i += 1
            self.listed(self.type_parameter, "]")
        self.take("=")
        self.type()

    def type_parameter(self) -> None:
        self.ident()
        while self.take(","):
            self.ident()
        self.constraint()

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")")

    def parameter(self) -> None:
        self.take("...")
        self.type()
        if self.s[self.i] not in ",)":
            self.take("...")
            self.type()

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.s[self.i] in "i*[(" or self.s[self.i] in self.grammar.chars("map chan func struct interface <-"):
            self.type()

    def type(self) -> None:
        c, k = self.c, self.s[self.i]
        self.depth += 1
        if self.depth > self.MAX_DEPTH:
            raise Bad(self.i, "nesting too deep")
        if k == "*":
            self.i += 1
            self.type()
        elif k == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.expression()
                self.need("]")
            self.type()
        elif k == c["map"]:
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == c["chan"] or k == c["<-"]:
            self.take("<-")
            self.need("chan")
            self.take("<-")
            self.type()
        elif k == c["func"]:
            self.i += 1
            self.signature()
        elif k == c["struct"]:
            self.i += 1
            self.need("{")
            self.many(self.field, "}", "field")
            self.need("}")
        elif k == c["interface"]:
            self.i += 1
            self.need("{")
            self.many(self.method, "}", "method")
            self.need("}")
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        else:
            self.ident()
            if self.take("."):
                self.ident()
            if self.at("[") and self.s[self.i + 1] != "]":
                self.tries(self.type_arguments)
        self.depth -= 1

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.take(","):
            self.type()
        self.need("]")

    def field(self) -> None:
        if self.at("*"):
            self.type()
        else:
            self.ident()
            if self.take("."):
                self.ident()
            elif self.s[self.i] not in "s;\n}":
                while self.take(","):
                    self.ident()
                self.type()
        self.take("s")
        self.end()

    def method(self) -> None:
        if self.at("i") and self.ahead("("):
            self.i += 1
            self.signature()
        else:
            self.constraint()
        self.end()

    def block(self) -> None:
        self.need("{")
        kept, self.literals = self.literals, True
        self.many(self.statement, "}", "statement")
        self.literals = kept
        self.need("}")

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def simple(self) -> None:
        if self.take("range"):
            return self.expression()
        self.expressions()
        if self.s[self.i] in self.ASSIGN:
            self.i += 1
            self.take("range")
            self.expressions()
        elif self.take("++") or self.take("--"):
            pass
        elif self.take("<-"):
            self.expression()

    def header(self) -> int:
        """Simple statements between ``;`` up to a block; how many ``;``."""
        kept, self.literals = self.literals, False
        parts = 0
        while not self.at("{"):
            if self.take(";"):
                parts += 1
                if parts > 2:
                    raise self.bad("{")
            else:
                if self.take("var"):
                    self.value_spec()
                else:
                    self.simple()
                if not self.at(";") and not self.at("{"):
                    raise self.bad("{")
        self.literals = kept
        return parts

    def statement(self) -> None:
        c, s, i = self.c, self.s, self.i
        k = s[i]
        if k == ";":
            self.i += 1
        elif self.declaration():
            pass
        elif k == "{":
            self.block()
            self.end()
        elif k == c["if"]:
            self.conditional_statement()
            self.end()
        elif k == c["for"]:
            self.i += 1
            self.header()
            self.block()
            self.end()
        elif k in (c["switch"], c["select"]):
            self.i += 1
            self.header()
            self.need("{")
            self.many(self.case, "}", "case")
            self.need("}")
            self.end()
        elif k in (c["go"], c["defer"]):
            self.i += 1
            self.expression()
            self.end()
        elif k == c["return"]:
            self.i += 1
            if s[self.i] not in ";\n}":
                self.expressions()
            self.end()
        elif k in (c["break"], c["continue"], c["goto"], c["fallthrough"]):
            self.i += 1
            self.take("i")
            self.end()
        elif k == "i" and s[i + 1] == ":":
            self.i += 2
            self.take("\n")
            if not self.at("}"):
                self.statement()
        else:
            self.simple()
            self.end()

    def conditional_statement(self) -> None:
        self.need("if")
        if self.at("{"):
            raise self.bad("a condition")
        self.header()
        self.block()
        if self.take("else"):
            if self.at("if"):
                self.conditional_statement()
            else:
                self.block()

    def case(self) -> None:
        if self.take("case"):
            self.simple_or_types()
        else:
            self.need("default")
        self.need(":")
        while not (self.at("case") or self.at("default") or self.s[self.i] in "}\0"):
            if not self.take("\n"):
                self.statement()

    def simple_or_types(self) -> None:
        if not self.tries(self.case_values):
            self.type()
            while self.take(","):
                self.type()

    def case_values(self) -> None:
        self.simple()
        if not self.at(":"):
            raise self.bad(":")

    def primary(self) -> None:
        c, k = self.c, self.s[self.i]
        if k in "ins":
            self.i += 1
        elif k == "(":
            self.i += 1
            kept, self.literals = self.literals, True
            if not self.tries(self.inner):
                self.type()
                self.need(")")
            self.literals = kept
        elif k == c["func"]:
            self.i += 1
            self.signature()
            if self.at("{"):
                self.block()
        elif k == "[" or k in (c["map"], c["chan"], c["struct"], c["interface"]):
            self.type()
            if self.at("{"):
                self.literal()
            elif not self.at("("):
                if self.s[self.i] not in ",)":
                    raise self.bad("a value")
        else:
            raise self.bad("an expression")

    def inner(self) -> None:
        self.expression()
        self.need(")")

    def literal(self) -> None:
        self.need("{")
        kept, self.literals = self.literals, True
        self.listed(self.element, "}")
        self.literals = kept

    def element(self) -> None:
        for _ in range(2):
            if self.at("{"):
                self.literal()
            else:
                self.expression()
            if not self.take(":"):
                return

    def postfix(self) -> None:
        while True:
            k = self.s[self.i]
            if k == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                else:
                    self.ident()
            elif k == "(":
                self.i += 1
                kept, self.literals = self.literals, True
                self.listed(self.argument, ")")
                self.literals = kept
            elif k == "[":
                self.i += 1
                while not self.take("]"):
                    if not (self.take(":") or self.take(",")):
                        if not self.tries(lambda: self.expression()):
                            self.type()
            elif k == "{" and self.literals and self.s[self.i - 1] in "i]":
                self.literal()
            else:
                return

    def argument(self) -> None:
        def value() -> None:
            self.expression()
            self.take("...")
            if self.s[self.i] not in ",)":
                raise self.bad(",")

        if not self.tries(value):
            start = self.i
            try:
                self.type()
            except Bad:
                self.i = start
                value()


_RUST_WORDS = "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn union macro_rules"
_RUST_TOKEN = _SKIP + r"|\n)*+(r#*\"[\s\S]*?\"#*|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x..|u\{[^}]*\}|.))'|'[^\W\d]\w*|[^\W\d]\w*|\d[\w]*(?:\.\d[\w]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?\w*|\.\.\.|\.\.=?|=>|->|::|&&|\|\||[=!]=|<<=?|<=|>=|[-+*/%&|^]=|\S|\Z)"


def _rust_kind(token: str) -> str:
    if token[0] == "'" and (len(token) == 1 or token[-1] != "'"):
        return "l" if len(token) > 1 else "E"
    return "s" if token[-1] in "\"#" and '"' in token and len(token) > 1 else classify(token)


RUST = Grammar(_RUST_WORDS, _OPERATORS + " $ .. ..=", _RUST_TOKEN, classify=_rust_kind)


class Rust(Parser):
    grammar = RUST
    SIMPLE = re.compile("[^;{}\0]*;")
    IDENT = RUST.chars("i union macro_rules")
    PATH = IDENT | RUST.chars("self Self super crate")
    BINARY = RUST.binary(["= += -= *= /= %= &= |= ^= <<=", ".. ..=", "||", "&&", "== != < > <= >=", "|", "^", "&", "<<", "+ -", "* / %", "as"])
    RIGHT = RUST.chars("= += -= *= /= %= &= |= ^= <<=")
    PREFIX = RUST.chars("- ! * & && mut")
    MORE = RUST.chars("> >=")
    BLOCKS = RUST.chars("if match while for loop unsafe { l")
    literals = True

    @staticmethod
    def prepare(text: str) -> str:
        return text

    def file(self):
        while True:
            self.many(self.item, "\0", "item")
            if self.s[self.i] == "\0":
                return self.errors

    def attributes(self) -> None:
        while self.at("#") and (self.ahead("[") or self.ahead("!") and self.ahead("[", 2)):
            self.i += 2 if self.ahead("!") else 1
            self.tree()

    def tree(self) -> None:
        """A balanced group of tokens."""
        pairs = {"(": ")", "[": "]", "{": "}"}
        if self.s[self.i] not in pairs:
            raise self.bad("(")
        stack = [pairs[self.s[self.i]]]
        self.i += 1
        while stack:
            k = self.s[self.i]
            if k in pairs:
                stack.append(pairs[k])
            elif k in ")]}":
                if k != stack.pop():
                    raise self.bad("a matching bracket")
            elif k in "\0E":
                raise self.bad("a closing bracket")
            self.i += 1

    def item(self) -> None:
        self.attributes()
        c = self.c
        if self.take("pub") and self.at("(") and self.s[self.i + 1] in self.grammar.chars("crate super self in"):
            self.tree()
        k, follows = self.s[self.i], self.s[self.i + 1]
        if k == c["use"]:
            self.i += 1
            self.use_tree()
            self.need(";")
        elif k == c["mod"]:
            self.i += 1
            self.ident()
            if not self.take(";"):
                self.body(self.item, "item")
        elif k == c["struct"] or k == c["union"] and follows == "i":
            self.i += 1
            self.ident()
            self.generics()
            if self.take("("):
                self.listed(self.tuple_field, ")")
                self.where()
                return self.need(";")
            self.where()
            if not self.take(";"):
                self.need("{")
                self.listed(self.named_field, "}")
        elif k == c["enum"]:
            self.i += 1
            self.ident()
            self.generics()
            self.where()
            self.need("{")
            self.listed(self.variant, "}")
        elif k == c["impl"] or k == c["unsafe"] and follows == c["impl"]:
            self.take("unsafe")
            self.i += 1
            if self.at("<"):
                self.generics()
            self.take("!")
            self.type()
            if self.take("for"):
                self.type()
            self.where()
            self.body(self.item, "item")
        elif k == c["trait"] or k == c["unsafe"] and follows == c["trait"]:
            self.take("unsafe")
            self.i += 1
            self.ident()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            self.body(self.item, "item")
        elif k in (c["const"], c["static"]) and follows not in (c["fn"], c["unsafe"], c["async"], c["extern"], "{"):
            self.i += 1
            self.take("mut")
            self.ident()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
            self.need(";")
        elif k == c["type"]:
            self.i += 1
            self.ident()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type()
            self.where()
            self.need(";")
        elif k == c["extern"] and (follows == "{" or follows == "s" and self.ahead("{", 2)):
            self.i += 1
            self.take("s")
            self.body(self.item, "item")
        elif k == c["extern"] and follows == c["crate"]:
            self.i += 2
            self.i += 1
            if self.take("as"):
                self.ident()
            self.need(";")
        elif k in self.PATH and (follows == "!" or follows == c["::"]):
            self.path(False)
            self.need("!")
            self.take("i")
            braces = self.at("{")
            self.tree()
            if not braces:
                self.need(";")
        else:
            while self.s[self.i] in self.grammar.chars("const async unsafe extern s"):
                self.i += 1
            if not self.at("fn"):
                raise self.bad("an item")
            self.i += 1
            self.ident()
            self.generics()
            self.need("(")
            self.listed(self.parameter, ")")
            if self.take("->"):
                self.type()
            self.where()
            if not self.take(";"):
                self.block()

    def body(self, rule, context: str) -> None:
        self.need("{")
        while self.at("#") and self.ahead("!"):
            self.attributes()
        self.many(rule, "}", context)
        self.need("}")

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.take("*"):
                return
            if self.take("{"):
                return self.listed(self.use_tree, "}")
            if self.s[self.i] not in self.PATH:
                raise self.bad("a name")
            self.i += 1
            if not self.take("::"):
                break
        if self.take("as"):
            self.ident()

    def tuple_field(self) -> None:
        self.attributes()
        if self.take("pub") and self.at("(") and self.s[self.i + 1] in self.grammar.chars("crate super self in"):
            self.tree()
        self.type()

    def named_field(self) -> None:
        self.attributes()
        if self.take("pub") and self.at("("):
            self.tree()
        self.ident()
        self.need(":")
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.ident()
        if self.take("("):
            self.listed(self.tuple_field, ")")
        elif self.take("{"):
            self.listed(self.named_field, "}")
        if self.take("="):
            self.expression()

    def generics(self) -> None:
        if not self.take("<"):
            return
        while not self.take(">"):
            self.attributes()
            self.take("const")
            if not self.take("l"):
                self.ident()
            if self.take(":"):
                self.bounds()
            if self.take("="):
                self.generic_argument()
            if not self.take(","):
                self.need(">")
                return

    def bounds(self) -> None:
        while True:
            if self.take("l"):
                pass
            elif self.take("("):
                self.bounds()
                self.need(")")
            elif self.s[self.i] in self.PATH or self.at("?") or self.at("for") or self.at("::") or self.at("~"):
                self.take("?") or self.take("~") and self.take("const")
                self.higher()
                self.path(True)
            if not self.take("+"):
                return

    def higher(self) -> None:
        if self.at("for") and self.ahead("<"):
            self.i += 1
            self.generics()

    def where(self) -> None:
        if self.take("where"):
            while self.s[self.i] not in "{;=\0":
                if self.take("l"):
                    pass
                else:
                    self.higher()
                    self.type()
                if self.take(":"):
                    self.bounds()
                if not self.take(","):
                    return

    def parameter(self) -> None:
        self.attributes()
        if self.take("..."):
            return
        start = self.i
        if self.take("&"):
            self.take("l")
        self.take("mut")
        if self.take("self"):
            if self.take(":"):
                self.type()
            return
        self.i = start
        self.pattern()
        self.need(":")
        self.type()

    def path(self, types: bool) -> None:
        self.take("::")
        while True:
            if self.s[self.i] not in self.PATH:
                raise self.bad("a name")
            self.i += 1
            if types and self.at("<"):
                self.generic_arguments()
            elif types and self.at("("):
                self.i += 1
                self.listed(self.type, ")")
                if self.take("->"):
                    self.type()
            if not self.at("::"):
                return
            if self.ahead("<"):
                self.i += 1
                self.generic_arguments()
                if not self.at("::"):
                    return
            self.i += 1

    def generic_arguments(self) -> None:
        self.need("<")
        while not self.take(">"):
            self.generic_argument()
            if not self.take(","):
                self.need(">")
                return

    def generic_argument(self) -> None:
        if self.take("l"):
            return
        if self.s[self.i] in "ns{" or self.at("-") or self.at("true") or self.at("false"):
            self.unary()
            return
        if self.at("i") and self.ahead("="):
            self.i += 2
            return self.type()
        self.type()
        if self.take("=") :
            self.type()
        elif self.take(":"):
            self.bounds()

    def type(self) -> None:
        c, k = self.c, self.s[self.i]
        self.depth += 1
        if self.depth > self.MAX_DEPTH:
            raise Bad(self.i, "nesting too deep")
        if k == "&" or k == c["&&"]:
            self.i += 1
            self.take("l")
            self.take("mut")
            self.type()
        elif k == "*":
            self.i += 1
            if not (self.take("const") or self.take("mut")):
                raise self.bad("const or mut")
            self.type()
        elif k == "(":
            self.i += 1
            self.listed(self.type, ")")
        elif k == "[":
            self.i += 1
            self.type()
            if self.take(";"):
                self.expression()
            self.need("]")
        elif k == "!":
            self.i += 1
        elif k in (c["dyn"], c["impl"]):
            self.i += 1
            self.bounds()
        elif k == "<":
            self.i += 1
            self.type()
            if self.take("as"):
                self.type()
            self.need(">")
            self.need("::")
            self.path(True)
        else:
            self.higher()
            while self.s[self.i] in self.grammar.chars("unsafe extern s") :
                self.i += 1
            if self.take("fn"):
                self.need("(")
                self.listed(self.fn_type_parameter, ")")
                if self.take("->"):
                    self.type()
            else:
                self.path(True)
                if self.at("!") and self.s[self.i + 1] in "([{":
                    self.i += 1
                    self.tree()
        self.depth -= 1

    def fn_type_parameter(self) -> None:
        if self.at("i") and self.ahead(":"):
            self.i += 2
        self.type()

    def pattern(self) -> None:
        self.take("|")
        self.pattern_operand()
        while self.take("|"):
            self.pattern_operand()

    def pattern_operand(self) -> None:
        c = self.c
        while self.take("&") or self.take("&&") or self.take("ref") or self.take("mut"):
            pass
        k = self.s[self.i]
        if k == "(":
            self.i += 1
            self.listed(self.pattern, ")")
        elif k == "[":
            self.i += 1
            self.listed(self.pattern, "]")
        elif k in (c[".."], c["..="]):
            self.i += 1
            if self.s[self.i] in "ns-":
                self.take("-")
                self.i += 1
            return
        elif k in "ns-" or k in (c["true"], c["false"]):
            self.take("-")
            self.i += 1
        elif k in self.PATH or k in ("<", c["::"]):
            if k == "<":
                self.type()
            else:
                self.path(False)
            if self.take("("):
                self.listed(self.pattern, ")")
            elif self.take("{"):
                self.listed(self.field_pattern, "}")
            elif self.take("@"):
                self.pattern()
            elif self.at("!"):
                self.i += 1
                self.tree()
        else:
            raise self.bad("a pattern")
        if self.take("..=") or self.take("..") or self.take("..."):
            if self.s[self.i] in "ns-":
                self.take("-")
                self.i += 1
            elif self.s[self.i] in self.PATH:
                self.path(False)

    def field_pattern(self) -> None:
        self.attributes()
        if self.take(".."):
            return
        while self.take("ref") or self.take("mut"):
            pass
        if not self.take("n"):
            self.ident()
        if self.take(":"):
            self.pattern()

    def block(self) -> None:
        self.need("{")
        kept, self.literals = self.literals, True
        self.many(self.statement, "}", "statement")
        self.literals = kept
        self.need("}")

    def statement(self) -> None:
        self.attributes()
        c, s, i = self.c, self.s, self.i
        k = s[i]
        if k == ";":
            self.i += 1
        elif k == c["let"]:
            self.i += 1
            self.pattern()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
                if self.take("else"):
                    self.block()
            self.need(";")
        elif k in self.grammar.chars("fn use mod struct enum trait impl type static pub extern macro_rules") or k == c["const"] and s[i + 1] != "{" or k in (c["unsafe"], c["async"]) and s[i + 1] == c["fn"] or k == c["union"] and s[i + 1] == "i":
            self.item()
        else:
            blocky = k in self.BLOCKS
            if blocky:
                self.primary()
                if self.s[self.i] in ".?":
                    self.postfix()
                    blocky = False
                    if self.s[self.i] in self.BINARY:
                        self.i += 1
                        self.expression()
                elif self.s[self.i] in self.BINARY and self.s[self.i] not in self.grammar.chars("* & - && || |"):
                    self.i += 1
                    self.expression()
                    blocky = False
            else:
                macro = k in self.IDENT and s[i + 1] == "!" and s[i + 2] == "{"
                self.expression()
                blocky = macro and self.s[self.i - 1] == "}"
            if not self.take(";") and not self.at("}") and not blocky:
                raise self.bad(";")

    def condition(self) -> None:
        kept, self.literals = self.literals, False
        self.expression()
        self.literals = kept

    def operand_after(self, op: str, least: int) -> None:
        if op == self.c["as"]:
            return self.type()
        if op in (self.c[".."], self.c["..="]) and (self.s[self.i] in ")]},;\0" or self.s[self.i] == "{" and not self.literals or self.at("=>")):
            return
        self.expression(least)

    def unary(self) -> None:
        while self.s[self.i] in self.PREFIX:
            self.i += 1
        self.primary()
        self.postfix()

    def primary(self) -> None:
        c, k = self.c, self.s[self.i]
        if k in self.PATH or k == c["::"]:
            self.path(False)
            if self.at("!") and self.s[self.i + 1] in "([{":
                self.i += 1
                self.tree()
            elif self.at("{") and self.literals and self.struct_follows():
                self.i += 1
                self.listed(self.field_value, "}")
        elif k in "ns" or k in (c["true"], c["false"]):
            self.i += 1
        elif k == "(":
            self.i += 1
            kept, self.literals = self.literals, True
            self.listed(self.expression, ")")
            self.literals = kept
        elif k == "[":
            self.i += 1
            kept, self.literals = self.literals, True
            while not self.take("]"):
                self.expression()
                if not (self.take(",") or self.take(";")):
                    self.need("]")
                    break
            self.literals = kept
        elif k == "{":
            self.block()
        elif k == "l":
            self.i += 1
            self.need(":")
            self.primary()
        elif k in (c["unsafe"], c["loop"]):
            self.i += 1
            self.block()
        elif k == c["async"]:
            self.i += 1
            self.take("move")
            if self.at("{"):
                self.block()
            else:
                self.primary()
        elif k == c["if"]:
            self.i += 1
            self.condition()
            self.block()
            if self.take("else"):
                if self.at("if"):
                    self.primary()
                else:
                    self.block()
        elif k == c["let"]:
            self.i += 1
            self.pattern()
            self.need("=")
            self.expression(4)
        elif k == c["while"]:
            self.i += 1
            self.condition()
            self.block()
        elif k == c["for"]:
            self.i += 1
            self.pattern()
            self.need("in")
            self.condition()
            self.block()
        elif k == c["match"]:
            self.i += 1
            self.condition()
            self.need("{")
            kept, self.literals = self.literals, True
            while not self.take("}"):
                self.attributes()
                self.pattern()
                if self.take("if"):
                    self.expression()
                self.need("=>")
                braced = self.at("{")
                self.expression()
                if not self.take(",") and not self.at("}") and not (braced or self.s[self.i - 1] == "}"):
                    raise self.bad(",")
            self.literals = kept
        elif k in (c["return"], c["break"]):
            self.i += 1
            self.take("l")
            if self.s[self.i] not in ";,)}]\0" and not self.at("=>"):
                self.expression()
        elif k == c["continue"]:
            self.i += 1
            self.take("l")
        elif k in ("|", c["||"], c["move"]):
            self.take("move")
            if not self.take("||"):
                self.need("|")
                self.listed(self.closure_parameter, "|")
            if self.take("->"):
                self.type()
                self.block()
            else:
                self.expression()
        elif k in (c[".."], c["..="]):
            self.i += 1
            self.operand_after(k, 3)
        elif k == "<":
            self.type()
        else:
            raise self.bad("an expression")

    def struct_follows(self) -> bool:
        a, b = self.s[self.i + 1], self.s[self.i + 2]
        return a == "}" or (a in self.IDENT or a == "n") and b in ":,}" or a == self.c[".."] or a == "#"

    def closure_parameter(self) -> None:
        self.pattern_operand()
        if self.take(":"):
            self.type()

    def field_value(self) -> None:
        self.attributes()
        if self.take(".."):
            if not self.at("}"):
                self.expression()
            return
        if not self.take("n"):
            self.ident()
        if self.take(":"):
            self.expression()

    def postfix(self) -> None:
        while True:
            k = self.s[self.i]
            if k == ".":
                self.i += 1
                if self.take("await") or self.take("n"):
                    continue
                self.ident()
                if self.at("::"):
                    self.i += 1
                    self.generic_arguments()
            elif k == "(":
                self.i += 1
                kept, self.literals = self.literals, True
                self.listed(self.expression, ")")
                self.literals = kept
            elif k == "[":
                self.i += 1
                kept, self.literals = self.literals, True
                self.expression()
                self.literals = kept
                self.need("]")
            elif k == "?":
                self.i += 1
            else:
                return


_RUBY_WORDS = "alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__"
_RUBY_OPS = _OPERATORS + " .. ... => =~ !~ <=> === &. ** **= ->"
_RUBY_TOKEN = (
    r"(?:[ \t\r\f\v ﻿]+|\\\n|^=begin\b[\s\S]*?^=end\b[^\n]*|#[^\n]*)*+(\n|<<[~-]?(?P<q>['\"]?)(?P<t>[A-Z_]\w*)(?P=q)(?=[^\n]*\n)|[^\W\d]\w*[?!](?![=~])|[^\W\d]\w*:(?![:])(?=[\s\"'\[\]({:,)}]|$)|[^\W\d]\w*|@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|[!-/:-@\d~])|\?[\w](?!\w)|:\"(?:[^\"\\]|\\[\s\S])*\"|:(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*|\[\]=?|[=!]=|<=>|<<|[+\-*/<>%!])(?<!::)|%[wWiIqQ]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})|"
    r"\d[\w]*(?:\.\d[\w]*)?(?:[eE][+-]?\d+)?|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|\.\.\.?|=>|<=>|===?|=~|!~|!=|->|::|&\.|&&=?|\|\|=?|\*\*=?|<<=?|>>=?|<=|>=|[-+*/%&|^]=|\S|\Z)"
)


def _ruby_kind(token: str) -> str:
    first = token[0]
    if first == ":" and len(token) > 1 or first == "?" and len(token) == 2 or first == "%" and len(token) > 2 or token[:2] == "<<" and len(token) > 3:
        return "s"
    if token[-1] == ":" and len(token) > 1:
        return "k"
    if first == "@" and len(token) > 1 or first == "$" and len(token) > 1:
        return "i"
    return classify(token)


RUBY = Grammar(_RUBY_WORDS, _RUBY_OPS + " >> >>=", "(?m)" + _RUBY_TOKEN, keep_lines=True, classify=_ruby_kind)
RUBY.token = re.compile(_RUBY_TOKEN.replace("(?P<q>['\\\"]?)(?P<t>[A-Z_]\\w*)(?P=q)", "(?:[A-Z_]\\w*|'[A-Z_]\\w*'|\\\"[A-Z_]\\w*\\\")"), re.M)
RUBY.idle = re.compile("(?<=[" + re.escape("".join(RUBY.code.get(w, w) for w in ", ( [ { | = + * / % < & ^ && || == != === <= >= += -= *= /= %= &= |= ^= <<= ** ||= &&= => =~ !~ <=> . &. :: ? : and or not ->".split())) + "])\n|^\n|\n(?=[" + re.escape("".join(RUBY.code.get(w, w) for w in ". &. ) ]".split())) + "\0])")
_HEREDOC = re.compile(r"(<<[~-](['\"]?)([A-Za-z_]\w*)\2[^\n]*\n)[\s\S]*?^[ \t]*\3[ \t]*$\n?", re.M)
_RUBY_REGEX = re.compile(r"((?:[=(,:\[!&|?{};~]|\b(?:if|unless|when|and|or|not|return|split|match|match\?|sub|gsub|scan|while|until)\b)[ \t]*\(?)/(?![ \t=])(?:[^/\\\n]|\\.)*/[imxounse]*")


class Ruby(Parser):
    grammar = RUBY
    ENDS = ";\n"
    SIMPLE = re.compile("[^;{}\n\0]*[;\n]")
    IDENT = RUBY.chars("i self nil true false __FILE__ __LINE__ super")
    ANY = IDENT | RUBY.chars("alias and begin break case class def do else elsif end ensure for if in module next not or redo rescue retry return then undef unless until when while yield k")
    BINARY = RUBY.binary(["and or", "= += -= *= /= %= &= |= ^= <<= >>= **= ||= &&=", "?", ".. ...", "||", "&&", "<=> == === != =~ !~", "< <= > >=", "| ^", "&", "<< >>", "+ -", "* / %", "**"])
    RIGHT = RUBY.chars("= += -= *= /= %= &= |= ^= <<= >>= **= ||= &&= **")
    PREFIX = RUBY.chars("! - + ~ not & * ** defined?")
    MODIFIERS = RUBY.chars("if unless while until rescue")
    STARTS = IDENT | frozenset("ns[") | RUBY.chars("-> :: ! defined? not lambda yield case if unless begin def k ..")
    braces = True

    @staticmethod
    def prepare(text: str) -> str:
        text = text.split("\n__END__\n")[0]
        if "<<" in text:
            text = _HEREDOC.sub(r"\1", text)
        return _RUBY_REGEX.sub(r"\g<1>0", text) if "/" in text else text

    def file(self):
        while True:
            self.many(self.statement, "\0", "statement")
            if self.s[self.i] == "\0":
                return self.errors

    def end(self) -> None:
        if self.s[self.i] in ";\n":
            self.i += 1
        elif self.s[self.i] not in "}\0)" and self.s[self.i] not in self.CLOSERS:
            raise self.bad("the end of the statement")

    CLOSERS = RUBY.chars("end else elsif when in rescue ensure then")

    def body(self, *also: str) -> None:
        """Statements up to ``end`` or one of ``also`` (not consumed)."""
        stops = self.grammar.chars(" ".join(("end", *also)))
        known = self.grammar.known.setdefault("statement", set())
        while True:
            k = self.s[self.i]
            if k in ";\n":
                self.i += 1
                continue
            if k in stops:
                return
            if k == "\0":
                raise self.bad("end")
            m = self.SIMPLE.match(self.s, self.i)
            if m and m.group() in known:
                self.i = m.end()
                continue
            start = self.i
            self.statement()
            if m and self.i == m.end():
                known.add(m.group())

    def statement(self) -> None:
        self.simple()
        while self.s[self.i] in self.MODIFIERS:
            self.i += 1
            self.expression()
        self.end()

    def simple(self) -> None:
        c, k = self.c, self.s[self.i]
        if k == c["alias"]:
            self.i += 3
        elif k == c["undef"]:
            self.i += 2
        elif k in (c["BEGIN"], c["END"]):
            self.i += 1
            self.braced()
        else:
            self.expression()
            while self.take(","):
                self.take("*")
                self.expression()
            if self.take("="):
                self.values()
            if self.take("=>") or self.take("in"):
                self.expression()

    def values(self) -> None:
        self.take("*")
        self.expression()
        while self.take(","):
            self.take("*")
            self.expression()

    def operand_after(self, op: str, least: int) -> None:
        if op in (self.c[".."], self.c["..."]) and self.s[self.i] in ")]\n;\0":
            return
        self.take("\n")
        self.expression(least)
        if op == self.c["="] and self.at(",") and not self.nested:
            while self.take(","):
                self.take("*")
                self.expression()
        if op in self.RIGHT and self.at("rescue"):
            self.i += 1
            self.expression()

    nested = 0

    def conditional(self) -> bool:
        self.need("?")
        self.take("\n")
        if self.take("k"):
            self.expression()
            return True
        self.expression(3)
        self.take("\n")
        self.need(":")
        self.take("\n")
        self.expression(3)
        return True

    def primary(self) -> None:
        c, k = self.c, self.s[self.i]
        if k in self.IDENT:
            self.i += 1
            if self.s[self.i] in "(" or self.s[self.i - 1] not in "i" and self.s[self.i - 1] != c["super"]:
                return
            self.command()
        elif k in "ns":
            self.i += 1
            while k == "s" and self.at("s"):
                self.i += 1
        elif k == "k":
            self.pairs("")
        elif k == "(":
            self.i += 1
            kept, self.nested = self.nested, 0
            while not self.take(")"):
                if self.s[self.i] in ";\n":
                    self.i += 1
                    continue
                self.statement_in_parens()
            self.nested = kept
        elif k == "[":
            self.i += 1
            self.items("]")
        elif k == "{":
            self.i += 1
            self.pairs("}")
        elif k == c["->"]:
            self.i += 1
            if self.take("("):
                self.parameters(")")
            elif self.s[self.i] in "ik*":
                self.parameters("")
            if not self.do_block() and not self.at("{"):
                raise self.bad("a block")
            if self.at("{"):
                self.braced()
        elif k == c["::"]:
            self.i += 1
            self.need("i")
        elif k == c["def"]:
            self.definition()
        elif k == c["class"]:
            self.i += 1
            if self.take("<<"):
                self.expression()
            else:
                self.constant()
                if self.take("<"):
                    self.expression()
            self.end()
            self.ensured()
        elif k == c["module"]:
            self.i += 1
            self.constant()
            self.end()
            self.body()
            self.need("end")
        elif k in (c["if"], c["unless"]):
            self.i += 1
            self.expression()
            self.then()
            self.body("else", "elsif")
            while self.take("elsif"):
                self.expression()
                self.then()
                self.body("else", "elsif")
            if self.take("else"):
                self.body()
            self.need("end")
        elif k in (c["while"], c["until"]):
            self.i += 1
            kept, self.blocks = self.blocks, False
            self.expression()
            self.blocks = kept
            self.take("do")
            self.body()
            self.need("end")
        elif k == c["for"]:
            self.i += 1
            self.need("i")
            while self.take(","):
                self.need("i")
            self.need("in")
            kept, self.blocks = self.blocks, False
            self.expression()
            self.blocks = kept
            self.take("do")
            self.body()
            self.need("end")
        elif k == c["case"]:
            self.i += 1
            if self.s[self.i] not in ";\n":
                self.expression()
            while self.s[self.i] in ";\n":
                self.i += 1
            if not (self.at("when") or self.at("in")):
                raise self.bad("when")
            while self.take("when") or self.take("in"):
                self.values()
                if self.take("if") or self.take("unless"):
                    self.expression()
                self.then()
                self.body("when", "in", "else")
            if self.take("else"):
                self.body()
            self.need("end")
        elif k == c["begin"]:
            self.i += 1
            self.ensured()
        elif k in (c["return"], c["break"], c["next"], c["yield"]):
            self.i += 1
            if k == c["yield"] and self.at("("):
                return
            if self.s[self.i] not in ";\n)}]\0:.?" and self.s[self.i] not in self.MODIFIERS and self.s[self.i] not in self.CLOSERS and self.s[self.i] not in self.BINARY:
                self.values()
        elif k in (c["redo"], c["retry"]):
            self.i += 1
        elif k in (c[".."], c["..."]):
            self.i += 1
            self.expression(5)
        else:
            raise self.bad("an expression")

    def statement_in_parens(self) -> None:
        self.simple()
        while self.s[self.i] in self.MODIFIERS:
            self.i += 1
            self.expression()
        if self.s[self.i] not in ";\n)":
            raise self.bad(")")

    blocks = True

    def constant(self) -> None:
        self.take("::")
        self.need("i")
        while self.take("::"):
            self.need("i")

    def then(self) -> None:
        if self.s[self.i] in ";\n":
            self.i += 1
            self.take("then")
        else:
            self.need("then")

    def ensured(self) -> None:
        """A body with rescue, else and ensure parts, and its end."""
        kept, self.nested = self.nested, 0
        blocks, self.blocks = self.blocks, True
        self.body("rescue", "else", "ensure")
        while self.take("rescue"):
            if self.s[self.i] not in ";\n" and not self.at("then"):
                if not self.at("=>"):
                    self.values()
                if self.take("=>"):
                    self.need("i")
            self.take("then")
            self.body("rescue", "else", "ensure")
        if self.take("else"):
            self.body("ensure")
        if self.take("ensure"):
            self.body()
        self.need("end")
        self.nested, self.blocks = kept, blocks

    def definition(self) -> None:
        self.need("def")
        operators = self.grammar.chars("+ - * / % ** == != < > <= >= <=> === =~ << >> ! ~ & | ^ [")
        if self.s[self.i] in self.ANY and self.ahead("."):
            self.i += 2
        if self.s[self.i] in operators:
            k = self.s[self.i]
            self.i += 1
            if k == "[":
                self.need("]")
                self.take("=")
            else:
                self.take("@")
        elif self.s[self.i] in self.ANY or self.at("s"):
            self.i += 1
            if self.at("=") and self.ahead("("):
                self.i += 1
        else:
            raise self.bad("a name")
        if self.take("("):
            self.parameters(")")
        elif self.s[self.i] in "ik*&" or self.at("**"):
            self.parameters("")
        if self.take("="):
            return self.expression()
        self.ensured()

    def parameters(self, close: str) -> None:
        """Of a method, block or lambda; up to and with ``close``."""
        self.nested += 1
        while True:
            if close and self.take(close):
                break
            self.take("\n")
            if self.take("("):
                self.parameters(")")
            elif self.take("*") or self.take("**") or self.take("&"):
                self.take("i") or self.take("nil")
            elif self.take("..."):
                pass
            elif self.take("k"):
                if self.s[self.i] not in ",)|\n":
                    self.expression(9 if close == "|" else 1)
            else:
                self.need("i")
                if self.take("="):
                    self.expression(10 if close == "|" else 3)
            self.take("\n") if close else None
            if self.take(";"):
                continue
            if not self.take(","):
                if close:
                    self.need(close)
                break
        self.nested -= 1

    def items(self, close: str) -> None:
        """Arguments or elements up to and with ``close``."""
        self.nested += 1
        blocks, self.blocks = self.blocks, True
        while True:
            self.take("\n")
            if self.take(close):
                break
            self.item()
            self.take("\n")
            if not self.take(","):
                self.need(close)
                break
        self.nested -= 1
        self.blocks = blocks

    def item(self) -> None:
        if self.take("*") or self.take("**") or self.take("&"):
            if self.s[self.i] not in ",)]":
                self.expression(2)
        elif self.take("k"):
            self.take("\n")
            if self.s[self.i] not in ",)]}\n":
                self.expression(2)
        else:
            self.expression(2)
            if self.take("=>") or self.at(":") and self.s[self.i - 1] == "s" and self.take(":"):
                self.take("\n")
                self.expression(2)

    def pairs(self, close: str) -> None:
        self.nested += 1
        while True:
            self.take("\n") if close else None
            if close and self.take(close):
                break
            if self.take("**"):
                self.expression(2)
            elif self.take("k"):
                self.take("\n")
                if self.s[self.i] not in ",}\n)":
                    self.expression(2)
            else:
                self.expression(2)
                if not self.take("=>"):
                    self.need(":")
                self.take("\n")
                self.expression(2)
            self.take("\n") if close else None
            if not self.take(","):
                if close:
                    self.need(close)
                break
            if not close and self.s[self.i] not in "ks":
                self.i -= 1
                break
        self.nested -= 1

    def command(self) -> None:
        """Arguments without parentheses after a name."""
        k = self.s[self.i]
        if (k in self.STARTS or k in (self.c["->"], self.c["yield"])) and not (k == "[" or k in self.MODIFIERS) and k not in self.CLOSERS:
            self.nested += 1
            while True:
                self.item()
                if not self.at(","):
                    break
                self.i += 1
                self.take("\n")
            self.nested -= 1

    def do_block(self) -> bool:
        if not self.blocks or not self.take("do"):
            return False
        if self.take("|"):
            self.parameters("|")
        self.ensured()
        return True

    def braced(self) -> None:
        self.need("{")
        kept, self.nested = self.nested, 0
        blocks, self.blocks = self.blocks, True
        if self.take("|"):
            self.parameters("|")
        self.many(self.statement, "}", "braced")
        self.nested, self.blocks = kept, blocks
        self.need("}")

    def postfix(self) -> None:
        c = self.c
        while True:
            k = self.s[self.i]
            if k == "." or k == c["&."] or k == c["::"]:
                self.i += 1
                self.take("\n")
                if self.at("("):
                    continue
                if self.s[self.i] not in self.ANY and self.s[self.i] not in self.grammar.chars("+ - * / % == < > << ! [ `"):
                    raise self.bad("a name")
                self.i += 1
                if not self.at("("):
                    self.command()
            elif k == "(":
                self.i += 1
                self.items(")")
            elif k == "[":
                self.i += 1
                self.items("]")
            elif k == "{" and self.s[self.i - 1] in "i)" + c["super"]:
                self.braced()
            elif k == c["do"] and self.do_block():
                pass
            else:
                return


PARSERS = {"js": Script, "mjs": Script, "cjs": Script, "ts": Typed, "mts": Typed, "cts": Typed, "java": Java, "c": C, "go": Go, "rs": Rust, "rb": Ruby}
