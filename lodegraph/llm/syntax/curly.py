"""Statements and expressions of JavaScript, TypeScript, Java and C."""

from __future__ import annotations

import re

from lodegraph.llm.syntax.engine import Bad, Grammar, Parser

_SKIP = r"(?:[ \t\r\f\v ﻿]+|//[^\n]*|/\*[\s\S]*?\*/"
_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_NUMBER = r"\.?\d(?:[eEpP][+-]|[\w.])*"
_OPERATORS = "( ) { } [ ] ; , . ? : = + - * / % < > & | ^ ! ~ @ # => ?. ?? ... ++ -- && || == != === !== <= >= += -= *= /= %= &= |= ^= <<= ** **= &&= ||= ??= << -> :: ' \" ` \\"
_JS_TOKEN = _SKIP + r")*+(\n|[^\W\d][\w$]*|\$[\w$]*|#[^\W\d][\w$]*|" + _NUMBER + r"|" + _STRING + r"|`(?:[^`\\]|\\[\s\S])*`|\.\.\.|=>|\?\.(?!\d)|\?\?=?|\*\*=?|\+\+|--|&&=?|\|\|=?|[=!]==?|<<=?|<=|>=|[-+*/%&|^]=|\S|\Z)"
_JS_WORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum null true false "
    "let static async await yield of get set abstract as asserts declare from implements infer interface is keyof module namespace never override private protected public readonly type unique satisfies accessor require global"
)
JS = Grammar(_JS_WORDS, _OPERATORS, _JS_TOKEN, keep_lines=True, enders="this super null true false break continue return debugger ++ -- let static async await yield of get set abstract as declare from implements interface is keyof module namespace never override private protected public readonly type require global default",
             continuers=": ? = + - * / % < > & | ^ && || == != === !== <= >= += -= *= /= %= &= |= ^= ** **= ?. ?? ... => ( [ { else catch finally in instanceof")
_REGEX_AFTER = re.compile(r"([=(,:\[!&|?{};]\s*|\b(?:return|typeof|case)\s+)/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


class Script(Parser):
    """JavaScript; ``typed`` adds TypeScript's types and declarations."""

    grammar = JS
    typed = False
    ENDS = ";\n"
    SIMPLE = re.compile("[^;{}\n\0]*[;\n]")
    IDENT = JS.chars("i let static async await yield of get set abstract as asserts declare from implements infer interface is keyof module namespace never override private protected public readonly type unique satisfies accessor require global")
    NAME = IDENT | JS.chars("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum null true false")
    MODIFIERS = JS.chars("static async get set abstract override private protected public readonly declare accessor *")
    BINARY = JS.binary(["= += -= *= /= %= &= |= ^= <<= **= &&= ||= ??= >=", "?", "?? ||", "&&", "|", "^", "&", "== != === !==", "< > <= in instanceof as satisfies", "<<", "+ -", "* / %", "**"])
    BINARY[JS.code[">="]] = 9
    RIGHT = JS.chars("= += -= *= /= %= &= |= ^= <<= **= &&= ||= ??= **")
    PREFIX = JS.chars("+ - ! ~ ++ -- typeof void delete await")
    MORE = JS.chars("> >=")

    @staticmethod
    def prepare(text: str) -> str:
        return _REGEX_AFTER.sub(r"\g<1>0", text) if "/" in text else text

    def file(self):
        if self.s[0] == "#" and self.s[1] == "!":
            self.i = self.s.find("\n") + 1 or len(self.s) - 3
        while True:
            self.many(self.statement, "\0", "statement")
            if self.s[self.i] == "\0":
                return self.errors

    def end(self) -> None:
        c = self.s[self.i]
        if c in ";\n":
            self.i += 1
        elif c not in "}\0" and self.s[self.i - 1] != "}":
            raise self.bad("the end of the statement")
        elif c not in "}\0" and self.s[self.i - 1] == "}":
            raise self.bad("the end of the statement")

    def block(self) -> None:
        self.need("{")
        self.many(self.statement, "}", "statement")
        self.need("}")

    def parens(self, rule) -> None:
        self.need("(")
        rule()
        self.need(")")

    def commas(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def statement(self) -> None:
        while self.take("\n"):
            pass
        c, s, i = self.c, self.s, self.i
        k = s[i]
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k in (c["var"], c["const"]) or k == c["let"] and s[i + 1] in self.IDENT | {"{", "["}:
            if k == c["const"] and s[i + 1] == c["enum"] and self.typed:
                self.i += 1
                return self.statement()
            self.i += 1
            self.declarators()
            self.end()
        elif k == c["function"] or k == c["async"] and s[i + 1] == c["function"]:
            self.function(needs_name=True)
        elif k == c["class"]:
            self.klass()
        elif k == "@":
            self.decorators()
            self.statement()
        elif k == c["if"]:
            self.i += 1
            self.parens(self.commas)
            self.statement()
            while self.s[self.i] in "\n" and self.s[self.i + 1] == c["else"]:
                self.i += 1
            if self.take("else"):
                self.statement()
        elif k == c["for"]:
            self.i += 1
            self.take("await")
            self.need("(")
            if self.s[self.i] in (c["var"], c["const"], c["let"]):
                self.i += 1
                self.binding()
                if self.take("of") or self.take("in"):
                    self.commas()
                    self.need(")")
                    return self.statement()
                if self.take("="):
                    self.expression()
                if self.take(","):
                    self.declarators()
            elif not self.at(";"):
                self.commas()
                if self.take("of"):
                    self.expression()
                if self.take(")"):
                    return self.statement()
            self.need(";")
            if not self.at(";"):
                self.commas()
            self.need(";")
            if not self.at(")"):
                self.commas()
            self.need(")")
            self.statement()
        elif k == c["while"]:
            self.i += 1
            self.parens(self.commas)
            self.statement()
        elif k == c["do"]:
            self.i += 1
            self.statement()
            self.take("\n")
            self.need("while")
            self.parens(self.commas)
            self.take(";")
        elif k == c["switch"]:
            self.i += 1
            self.parens(self.commas)
            self.need("{")
            self.many(self.case, "}", "case")
            self.need("}")
        elif k == c["try"]:
            self.i += 1
            self.block()
            if self.take("catch"):
                if self.take("("):
                    self.binding()
                    self.need(")")
                self.block()
                if self.take("finally"):
                    self.block()
            else:
                self.need("finally")
                self.block()
        elif k in (c["return"], c["throw"]):
            self.i += 1
            if self.s[self.i] not in ";\n}\0":
                self.commas()
            self.end()
        elif k in (c["break"], c["continue"], c["debugger"]):
            self.i += 1
            if self.s[self.i] in self.IDENT:
                self.i += 1
            self.end()
        elif k == c["import"] and s[i + 1] not in "(.":
            self.imports()
        elif k == c["export"]:
            self.exports()
        elif self.typed and self.typescript():
            pass
        elif k in self.IDENT and s[i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            self.commas()
            self.end()

    def case(self) -> None:
        if self.take("case"):
            self.commas()
        else:
            self.need("default")
        self.need(":")
        while not (self.at("case") or self.at("default") or self.s[self.i] in "}\0"):
            if not self.take("\n"):
                self.statement()

    def typescript(self) -> bool:
        c, s, i = self.c, self.s, self.i
        k, follows = s[i], s[i + 1]
        if k in (c["abstract"], c["declare"]) and (follows in self.NAME):
            self.i += 1
            self.statement()
        elif k == c["interface"] and follows in self.IDENT:
            self.i += 2
            self.type_parameters()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.type_members()
        elif k == c["type"] and follows in self.IDENT:
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.type()
            self.end()
        elif k == c["enum"]:
            self.i += 1
            self.ident()
            self.need("{")
            self.listed(self.enum_member, "}")
        elif k in (c["namespace"], c["module"], c["global"]) and (follows in self.IDENT or follows == "s" or k == c["global"] and follows == "{"):
            self.i += 1
            while self.s[self.i] in self.IDENT or self.at(".") or self.at("s"):
                self.i += 1
            if self.at("{"):
                self.block()
            else:
                self.end()
        else:
            return False
        return True

    def enum_member(self) -> None:
        if not self.take("s"):
            self.ident()
        if self.take("="):
            self.expression()

    def imports(self) -> None:
        self.need("import")
        if not self.at("s"):
            if self.typed and self.at("type") and (self.s[self.i + 1] in self.IDENT | {"{", "*"}) and not self.ahead("from"):
                self.i += 1
            if self.s[self.i] in self.IDENT:
                self.i += 1
                if self.typed and self.take("="):
                    self.expression()
                    return self.end()
                if not self.at("from"):
                    self.need(",")
            if self.take("*"):
                self.need("as")
                self.ident()
            elif self.take("{"):
                self.listed(self.specifier, "}")
            self.need("from")
        self.need("s")
        if self.take("with"):
            self.object()
        self.end()

    def specifier(self) -> None:
        if self.typed and self.at("type") and self.s[self.i + 1] in self.NAME and not self.ahead("as"):
            self.i += 1
        for _ in range(2):
            if not self.take("s"):
                if self.s[self.i] not in self.NAME:
                    raise self.bad("a name")
                self.i += 1
            if not self.take("as"):
                return

    def exports(self) -> None:
        self.need("export")
        if self.take("default"):
            if self.at("function") or self.at("async") and self.ahead("function"):
                return self.function()
            if self.at("class") or self.at("@") or self.at("abstract") or self.at("interface"):
                return self.klass() if self.at("class") else self.statement()
            self.expression()
            return self.end()
        if self.typed and self.at("type") and self.s[self.i + 1] in "{*":
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.i += 1
            self.need("from")
            self.need("s")
            return self.end()
        if self.take("{"):
            self.listed(self.specifier, "}")
            if self.take("from"):
                self.need("s")
            return self.end()
        if self.typed and self.take("="):
            self.expression()
            return self.end()
        c = self.c
        if self.s[self.i] not in (c["var"], c["let"], c["const"], c["function"], c["async"], c["class"], "@") and not (self.typed and self.s[self.i] in (c["abstract"], c["declare"], c["interface"], c["type"], c["enum"], c["namespace"], c["module"], c["import"])):
            raise self.bad("a declaration")
        self.statement()

    def declarators(self) -> None:
        while True:
            self.binding()
            if self.take("="):
                self.expression()
            if not self.take(","):
                return

    def binding(self) -> None:
        if self.at("{"):
            self.object()
        elif self.at("["):
            self.array()
        else:
            self.ident()
            self.take("!") if self.typed else None
        if self.typed and self.take(":"):
            self.type()

    def decorators(self) -> None:
        while self.take("@"):
            if not self.at("("):
                self.ident()
                while self.take("."):
                    self.ident()
            if self.at("("):
                self.arguments()
            self.take("\n")

    def function(self, needs_name: bool = False) -> None:
        self.take("async")
        self.need("function")
        self.take("*")
        if self.s[self.i] in self.IDENT:
            self.i += 1
        elif needs_name:
            raise self.bad("a name")
        self.signature()
        if self.at("{") or not self.typed:
            self.block()
        else:
            self.end()

    def signature(self) -> None:
        self.type_parameters()
        self.need("(")
        self.listed(self.parameter, ")")
        if self.typed and self.take(":"):
            self.type()

    def parameter(self) -> None:
        self.decorators()
        while self.typed and self.s[self.i] in self.MODIFIERS and self.s[self.i + 1] in self.IDENT:
            self.i += 1
        self.take("...")
        if self.take("this"):
            if self.take(":"):
                self.type()
            return
        if self.at("{"):
            self.object()
        elif self.at("["):
            self.array()
        else:
            self.ident()
        if self.typed:
            self.take("?")
            if self.take(":"):
                self.type()
        if self.take("="):
            self.expression()

    def klass(self) -> None:
        self.need("class")
        if self.s[self.i] in self.IDENT and not (self.at("implements") and not self.ahead("{")):
            self.i += 1
        self.type_parameters()
        if self.take("extends"):
            self.unary()
            if self.typed and self.at("<"):
                self.type_arguments()
        if self.typed and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        self.many(self.member, "}", "member" + str(self.typed))
        self.need("}")

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        after = self.grammar.chars("( = : ; ? ! < } ,") | {"\n"}
        while self.s[self.i] in self.MODIFIERS and self.s[self.i + 1] not in after:
            if not self.typed and self.s[self.i] not in self.grammar.chars("static async get set * accessor"):
                break
            self.i += 1
            if self.at("{"):
                return self.block()
        if self.take("["):
            self.expression()
            if self.typed and self.take(":"):
                self.type()
            elif self.typed and self.take("in"):
                self.type()
            self.need("]")
        elif self.s[self.i] in self.NAME or self.s[self.i] in "sn":
            self.i += 1
        else:
            raise self.bad("a member")
        if self.typed:
            self.take("?") or self.take("!")
        if self.at("(") or self.typed and self.at("<"):
            self.signature()
            if self.at("{") or not self.typed:
                return self.block()
            return self.end()
        if self.typed and self.take(":"):
            self.type()
        if self.take("="):
            self.expression()
        self.end()

    # types

    def type_parameters(self) -> None:
        if not self.typed or not self.take("<"):
            return
        def one() -> None:
            self.take("const")
            self.take("in")
            self.ident()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()

        self.listed(one, ">")

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            self.type()
        self.need(">")

    def type(self) -> None:
        self.depth += 1
        if self.depth > self.MAX_DEPTH:
            raise Bad(self.i, "nesting too deep")
        self.take("|") or self.take("&")
        self.type_operand()
        while self.take("|") or self.take("&"):
            self.type_operand()
        if self.take("extends"):
            self.type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()
        self.depth -= 1

    def type_operand(self) -> None:
        c, k = self.c, self.s[self.i]
        while k in (c["keyof"], c["readonly"], c["unique"], c["infer"], c["asserts"], c["abstract"], c["typeof"], c["new"]) and (self.s[self.i + 1] in self.NAME or self.s[self.i + 1] in "([{<"):
            self.i += 1
            k = self.s[self.i]
        if k in "sn" or k in (c["null"], c["true"], c["false"], c["void"], c["this"]):
            self.i += 1
        elif k == "-":
            self.i += 1
            self.need("n")
        elif k == "{":
            self.type_members()
        elif k == "[":
            self.i += 1
            self.listed(self.tuple_item, "]")
        elif k in "(<":
            if not self.tries(self.function_type):
                self.need("(")
                self.type()
                self.need(")")
        elif k == c["import"]:
            self.i += 1
            self.arguments()
        else:
            self.ident()
        while True:
            if self.at("."):
                self.i += 2
            elif self.at("<"):
                self.type_arguments()
            elif self.at("[") :
                self.i += 1
                if not self.take("]"):
                    self.type()
                    self.need("]")
            elif self.take("is"):
                self.type()
            else:
                return

    def tuple_item(self) -> None:
        self.take("...")
        if self.s[self.i] in self.IDENT and (self.ahead(":") or self.ahead("?") and self.ahead(":", 2)):
            self.i += 1
            self.take("?")
            self.need(":")
        self.type()
        self.take("?")

    def function_type(self) -> None:
        self.type_parameters()
        self.need("(")
        self.listed(self.parameter, ")")
        self.need("=>")
        self.type()

    def type_members(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.s[self.i] in ";,\n":
                self.i += 1
                continue
            while self.s[self.i] in self.grammar.chars("readonly get set + - new") and self.s[self.i + 1] not in self.grammar.chars("( : ? ; , }"):
                self.i += 1
            if self.take("["):
                self.ident() if self.s[self.i] in self.IDENT else self.expression()
                if self.take(":") or self.take("in"):
                    self.type()
                    if self.take("as"):
                        self.type()
                self.need("]")
            elif self.s[self.i] in self.NAME or self.s[self.i] in "sn":
                self.i += 1
            elif self.s[self.i] not in "(<":
                raise self.bad("a member")
            (self.take("-") or self.take("+")) and None
            self.take("?")
            if self.at("(") or self.at("<"):
                self.signature()
            elif self.take(":"):
                self.type()
            if self.s[self.i] not in ";,\n}":
                raise self.bad("the end of the member")

    # expressions

    def operand_after(self, op: str, least: int) -> None:
        if op in (self.c["as"], self.c["satisfies"]):
            if not self.typed:
                raise self.bad("an operator")
            if not self.take("const"):
                self.type()
        else:
            self.expression(least)

    def conditional(self) -> bool:
        if self.s[self.i + 1] in ":,)=":
            return False
        self.i += 1
        self.expression()
        self.need(":")
        self.expression()
        return True

    def primary(self) -> None:
        c, k = self.c, self.s[self.i]
        if k in self.IDENT:
            if k == c["async"] and self.ahead("function"):
                return self.function()
            if k == c["async"] and self.s[self.i + 1] in self.IDENT and self.ahead("=>", 2):
                self.i += 1
            if k == c["yield"] and self.s[self.i + 1] not in ";)]},\n=." + c["=>"]:
                self.i += 1
                self.take("*")
                return self.expression()
            self.i += 1
            if self.take("=>"):
                self.arrow_body()
        elif k in "sn" or k in (c["this"], c["super"], c["null"], c["true"], c["false"]):
            self.i += 1
        elif k == "(":
            self.parenthesis()
        elif k == "[":
            self.array()
        elif k == "{":
            self.object()
        elif k == c["function"]:
            self.function()
        elif k == c["class"]:
            self.klass()
        elif k == c["new"]:
            self.i += 1
            if self.take("."):
                return self.ident()
            self.primary()
        elif k == c["import"]:
            self.i += 1
        elif k == "@":
            self.decorators()
            self.klass()
        elif k == "<" and self.typed:
            if not self.tries(self.generic_arrow):
                self.type_arguments()
                self.unary()
        else:
            raise self.bad("an expression")

    def generic_arrow(self) -> None:
        self.type_parameters()
        self.parenthesis()
        if self.s[self.i - 1] == ")":
            raise self.bad("=>")

    def arrow_body(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.expression()

    def parenthesis(self) -> None:
        self.need("(")
        self.listed(self.item, ")")
        empty = self.s[self.i - 2] == "("
        if self.typed and self.at(":"):
            self.tries(self.arrow_type)
        if self.take("=>"):
            self.arrow_body()
        elif empty:
            raise self.bad("=>")

    def arrow_type(self) -> None:
        self.need(":")
        self.type()
        if not self.at("=>"):
            raise self.bad("=>")

    def item(self) -> None:
        self.take("...")
        if self.typed and self.at("this") and self.ahead(":"):
            self.i += 1
        else:
            self.expression()
        if self.typed:
            if self.at("?") and self.s[self.i + 1] in ":,)=":
                self.i += 1
            if self.take(":"):
                self.type()
                if self.take("="):
                    self.expression()

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.expression()
            if not self.take(","):
                self.need(")")
                return

    def array(self) -> None:
        self.need("[")
        while not self.take("]"):
            if self.take(","):
                continue
            self.take("...")
            self.expression()
            if not self.at("]"):
                self.need(",")

    def object(self) -> None:
        self.need("{")
        self.listed(self.property, "}")

    def property(self) -> None:
        if self.take("..."):
            return self.expression()
        while self.s[self.i] in self.grammar.chars("get set async * static") and self.s[self.i + 1] not in self.grammar.chars(", : ( } ="):
            self.i += 1
        if self.take("["):
            self.expression()
            self.need("]")
        elif self.s[self.i] in self.NAME or self.s[self.i] in "sn":
            self.i += 1
        else:
            raise self.bad("a property")
        if self.at("(") or self.typed and self.at("<"):
            self.signature()
            self.block()
        elif self.take(":"):
            self.expression()
        elif self.take("="):
            self.expression()

    def postfix(self) -> None:
        c = self.c
        while True:
            k = self.s[self.i]
            if k == "." or k == c["?."]:
                self.i += 1
                if k != "." and self.s[self.i] in "([":
                    continue
                if self.s[self.i] not in self.NAME:
                    raise self.bad("a name")
                self.i += 1
            elif k == "(":
                self.arguments()
                if self.at("=>"):
                    self.i += 1
                    self.arrow_body()
            elif k == "[":
                self.i += 1
                self.commas()
                self.need("]")
            elif k == "s" and self.s[self.i - 1] not in "sn":
                self.i += 1
            elif k in (c["++"], c["--"]):
                self.i += 1
            elif k == "!" and self.typed:
                self.i += 1
            elif k == "<" and self.typed and self.tries(self.typed_call):
                pass
            else:
                return

    def typed_call(self) -> None:
        self.type_arguments()
        if not self.at("("):
            raise self.bad("(")


class Typed(Script):
    typed = True


_JAVA_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public "
    "return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record sealed permits non var yield when"
)
_C_TOKEN = _SKIP + r"|\n)*+([^\W\d][\w$]*(?:\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.)*')?|" + _NUMBER + r"|\"\"\"[\s\S]*?\"\"\"|" + _STRING + r"|\.\.\.|->|::|\+\+|--|&&|\|\||[=!]=|<<=?|<=|>=|[-+*/%&|^]=|\S|\Z)"
JAVA = Grammar(_JAVA_WORDS, _OPERATORS, _C_TOKEN)


class Java(Parser):
    grammar = JAVA
    SIMPLE = re.compile("[^;{}\0]*;")
    IDENT = JAVA.chars("i record sealed permits var yield when non")
    BASIC = JAVA.chars("boolean byte char double float int long short void")
    MODIFIERS = JAVA.chars("abstract default final native private protected public static strictfp synchronized transient volatile sealed")
    BINARY = JAVA.binary(["= += -= *= /= %= &= |= ^= <<=", "?", "||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<<", "+ -", "* / %"])
    RIGHT = JAVA.chars("= += -= *= /= %= &= |= ^= <<=")
    PREFIX = JAVA.chars("+ - ! ~ ++ --")
    MORE = JAVA.chars("> >=")

    @staticmethod
    def prepare(text: str) -> str:
        return text

    def file(self):
        while True:
            self.many(self.unit, "\0", "unit")
            if self.s[self.i] == "\0":
                return self.errors

    def unit(self) -> None:
        if self.take(";"):
            return
        if self.take("import"):
            self.take("static")
            self.ident()
            while self.take("."):
                if not self.take("*"):
                    self.ident()
            return self.need(";")
        start = self.i
        self.modifiers()
        if self.take("package"):
            self.qualified()
            return self.need(";")
        if not self.type_declaration():
            self.i = start if self.i == start else self.i
            raise self.bad("a declaration")

    def qualified(self) -> None:
        self.ident()
        while self.take("."):
            self.ident()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and not self.ahead("interface"):
                self.i += 1
                self.qualified()
                if self.take("("):
                    self.listed(self.annotation_value, ")")
            elif self.s[self.i] in self.MODIFIERS and not (self.at("default") and self.s[self.i + 1] in ":" or self.at("synchronized") and self.ahead("(")) and not (self.at("sealed") and self.s[self.i + 1] in ".=(;"):
                self.i += 1
            elif self.at("non") and self.ahead("-"):
                self.i += 3
            else:
                return

    def annotation_value(self) -> None:
        if self.at("{"):
            self.i += 1
            self.listed(self.annotation_value, "}")
        elif self.at("@"):
            self.modifiers()
        elif self.s[self.i] in self.IDENT and self.ahead("="):
            self.i += 2
            self.annotation_value()
        else:
            self.expression()

    def type_declaration(self) -> bool:
        if self.take("class") or self.at("record") and self.s[self.i + 1] in self.IDENT and self.s[self.i + 2] in "(<":
            self.take("record")
            self.ident()
            self.type_parameters()
            if self.take("("):
                self.listed(self.parameter, ")")
            self.supertypes()
            self.body()
        elif self.take("interface") or self.at("@") and self.ahead("interface"):
            if self.take("@"):
                self.i += 1
            self.ident()
            self.type_parameters()
            self.supertypes()
            self.body()
        elif self.take("enum"):
            self.ident()
            self.supertypes()
            self.need("{")
            while self.s[self.i] in self.IDENT or self.at("@"):
                self.modifiers()
                self.ident()
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.body()
                if not self.take(","):
                    break
            if self.take(";"):
                self.many(self.member, "}", "member")
            self.need("}")
        else:
            return False
        return True

    def supertypes(self) -> None:
        while self.take("extends") or self.take("implements") or self.take("permits"):
            self.type()
            while self.take(",") or self.take("&"):
                self.type()

    def body(self) -> None:
        self.need("{")
        self.many(self.member, "}", "member")
        self.need("}")

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                self.modifiers()
                self.ident()
                if self.take("extends"):
                    self.type()
                    while self.take("&"):
                        self.type()
                if not self.take(","):
                    break
            self.need(">")

    def member(self) -> None:
        if self.take(";"):
            return
        self.modifiers()
        if self.at("{"):
            return self.block()
        if self.type_declaration():
            return
        self.type_parameters()
        if self.s[self.i] in self.IDENT and (self.ahead("(") or self.ahead("{")):
            self.i += 1
            if self.at("{"):
                return self.block()
        else:
            self.type()
            self.ident()
        if self.take("("):
            self.listed(self.parameter, ")")
            self.dimensions()
            if self.take("throws"):
                self.type()
                while self.take(","):
                    self.type()
            if self.at("{"):
                return self.block()
            if self.take("default"):
                self.annotation_value()
            return self.need(";")
        self.declarators()
        self.need(";")

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dimensions()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.ident()

    def initializer(self) -> None:
        if self.take("{"):
            self.listed(self.initializer, "}")
        else:
            self.expression()

    def dimensions(self) -> None:
        while self.at("[") and self.ahead("]"):
            self.i += 2

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        self.take("...")
        if not self.take("this"):
            self.ident()
        self.dimensions()

    def type(self) -> None:
        self.modifiers() if self.at("@") else None
        if self.take("?"):
            if self.take("extends") or self.take("super"):
                self.type()
            return
        if self.s[self.i] in self.BASIC:
            self.i += 1
        else:
            while True:
                self.ident()
                if self.take("<"):
                    if not self.take(">"):
                        self.type()
                        while self.take(","):
                            self.type()
                        self.need(">")
                if not (self.at(".") and self.s[self.i + 1] in self.IDENT):
                    break
                self.i += 1
        self.dimensions()

    def block(self) -> None:
        self.need("{")
        self.many(self.statement, "}", "statement")
        self.need("}")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def local(self) -> None:
        self.modifiers()
        self.type()
        self.ident()
        if self.s[self.i] not in "=;,[:":
            raise self.bad("a declarator")

    def statement(self) -> None:
        c, s, i = self.c, self.s, self.i
        k = s[i]
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k == c["if"]:
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif k == c["while"]:
            self.i += 1
            self.condition()
            self.statement()
        elif k == c["do"]:
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif k == c["for"]:
            self.i += 1
            self.need("(")
            if self.tries(self.local):
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    return self.statement()
                self.declarators()
            elif not self.at(";"):
                self.commas()
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.commas()
            self.need(")")
            self.statement()
        elif k == c["switch"]:
            self.switch()
        elif k == c["try"]:
            self.i += 1
            resources = self.take("(")
            if resources:
                while not self.take(")"):
                    if self.tries(self.local):
                        self.declarators()
                    else:
                        self.expression()
                    if not self.take(";"):
                        self.need(")")
                        break
            self.block()
            handled = False
            while self.take("catch"):
                handled = True
                self.need("(")
                self.modifiers()
                self.type()
                while self.take("|"):
                    self.type()
                self.ident()
                self.need(")")
                self.block()
            if self.take("finally"):
                self.block()
            elif not handled and not resources:
                raise self.bad("catch or finally")
        elif k in (c["return"], c["throw"]):
            self.i += 1
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif k in (c["break"], c["continue"]):
            self.i += 1
            if self.s[self.i] in self.IDENT:
                self.i += 1
            self.need(";")
        elif k == c["synchronized"] and s[i + 1] == "(":
            self.i += 1
            self.condition()
            self.block()
        elif k == c["assert"]:
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif k in self.IDENT and s[i + 1] == ":":
            self.i += 2
            self.statement()
        elif k in (c["class"], c["interface"], c["enum"]) or k in self.MODIFIERS and self.tries(self.local_type) or k == c["record"] and self.tries(self.type_declaration):
            if self.i == i:
                self.type_declaration()
        elif k == c["yield"] and s[i + 1] not in "=.([":
            self.i += 1
            self.expression()
            self.need(";")
        elif (k in self.IDENT or k in self.BASIC or k == "@" or k == c["final"]) and self.tries(self.local):
            self.declarators()
            self.need(";")
        else:
            self.expression()
            self.need(";")

    def local_type(self) -> bool:
        self.modifiers()
        return self.type_declaration()

    def switch(self) -> None:
        self.need("switch")
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                while True:
                    if not self.take("default") and not self.tries(self.pattern):
                        self.expression(2)
                    if not self.take(","):
                        break
                if self.take("when"):
                    self.expression()
            else:
                self.need("default")
            if self.take("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
                continue
            self.need(":")
            while not (self.at("case") or self.at("default") or self.s[self.i] in "}\0"):
                self.statement()

    def pattern(self) -> None:
        self.type()
        if self.take("("):
            self.listed(self.pattern, ")")
            return
        self.ident()

    def commas(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def operand_after(self, op: str, least: int) -> None:
        if op == self.c["instanceof"]:
            self.modifiers()
            self.type()
            if self.take("("):
                self.listed(self.pattern, ")")
            elif self.s[self.i] in self.IDENT:
                self.i += 1
        else:
            self.expression(least)

    def primary(self) -> None:
        c, k = self.c, self.s[self.i]
        if k in self.IDENT:
            self.i += 1
            if self.take("->"):
                self.lambda_body()
            elif self.at("<"):
                self.tries(self.generic_reference)
        elif k in "sn" or k in (c["this"], c["super"], c["null"], c["true"], c["false"]):
            self.i += 1
        elif k == "(":
            if self.tries(self.lambda_head):
                self.lambda_body()
            elif not self.tries(self.cast):
                self.i += 1
                self.expression()
                self.need(")")
        elif k == c["new"]:
            self.i += 1
            self.modifiers() if self.at("@") else None
            if self.s[self.i] in self.BASIC:
                self.i += 1
            else:
                self.type_name()
            if self.at("["):
                while self.take("["):
                    if not self.take("]"):
                        self.expression()
                        self.need("]")
                if self.at("{"):
                    self.initializer()
            else:
                self.arguments()
                if self.at("{"):
                    self.body()
        elif k in self.BASIC:
            self.i += 1
            self.dimensions()
            if not (self.at(".") or self.at("::")):
                raise self.bad(".class")
        elif k == c["switch"]:
            self.switch()
        else:
            raise self.bad("an expression")

    def generic_reference(self) -> None:
        self.i -= 1
        self.type()
        self.take("[") and self.need("]")
        if not self.at("::"):
            raise self.bad("::")

    def type_name(self) -> None:
        while True:
            self.ident()
            if self.take("<"):
                if not self.take(">"):
                    self.type()
                    while self.take(","):
                        self.type()
                    self.need(">")
            if not self.take("."):
                return

    def lambda_head(self) -> None:
        self.need("(")
        while not self.take(")"):
            if self.s[self.i] in self.IDENT and self.s[self.i + 1] in ",)":
                self.i += 1
            else:
                self.parameter()
            if not self.take(","):
                self.need(")")
                break
        self.need("->")

    def lambda_body(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.expression()

    def cast(self) -> None:
        self.need("(")
        basic = self.s[self.i] in self.BASIC
        self.type()
        while self.take("&"):
            self.type()
        self.need(")")
        k = self.s[self.i]
        if not (k in self.IDENT or k in "sn(!~" or k in self.grammar.chars("this super new null true false switch") or basic and k in self.PREFIX):
            raise self.bad("an operand")
        self.unary()

    def arguments(self) -> None:
        self.need("(")
        if not self.take(")"):
            self.commas()
            self.need(")")

    def postfix(self) -> None:
        c = self.c
        while True:
            k = self.s[self.i]
            if k == ".":
                self.i += 1
                if self.take("<"):
                    self.type()
                    while self.take(","):
                        self.type()
                    self.need(">")
                if self.take("new"):
                    self.type_name()
                    self.arguments()
                    if self.at("{"):
                        self.body()
                elif not (self.take("class") or self.take("this") or self.take("super")):
                    self.ident()
            elif k == "(":
                self.arguments()
            elif k == "[":
                self.i += 1
                if not self.take("]"):
                    self.expression()
                    self.need("]")
            elif k == c["::"]:
                self.i += 1
                if not self.take("new"):
                    self.ident()
            elif k in (c["++"], c["--"]):
                self.i += 1
            else:
                return


_C_WORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while "
    "_Bool _Complex _Atomic _Noreturn _Alignas _Alignof _Static_assert _Thread_local _Generic __attribute__ __inline __restrict __extension__ __asm__ asm"
)
C_LANGUAGE = Grammar(_C_WORDS, _OPERATORS, _C_TOKEN)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n\\/]|\\\r?\n|\\|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*", re.M)


class C(Parser):
    grammar = C_LANGUAGE
    SIMPLE = re.compile("[^;{}\0]*;")
    IDENT = frozenset("i")
    TYPES = C_LANGUAGE.chars("char double float int long short signed unsigned void _Bool _Complex")
    QUALIFIERS = C_LANGUAGE.chars("auto const extern inline register restrict static typedef volatile _Atomic _Noreturn _Thread_local __inline __restrict __extension__")
    BINARY = C_LANGUAGE.binary(["= += -= *= /= %= &= |= ^= <<=", "?", "||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<<", "+ -", "* / %"])
    RIGHT = C_LANGUAGE.chars("= += -= *= /= %= &= |= ^= <<=")
    PREFIX = C_LANGUAGE.chars("+ - ! ~ ++ -- & && *")
    MORE = C_LANGUAGE.chars("> >=")

    @staticmethod
    def prepare(text: str) -> str:
        return _DIRECTIVE.sub("", text) if "#" in text else text

    def file(self):
        while True:
            self.many(self.external, "\0", "external")
            if self.s[self.i] == "\0":
                return self.errors

    def external(self) -> None:
        if self.take(";"):
            return
        if self.at("_Static_assert") or self.at("asm") or self.at("__asm__"):
            self.i += 1
            self.arguments()
            return self.need(";")
        if not self.specifiers():
            raise self.bad("a declaration")
        self.declaration(True)

    def attributes(self) -> None:
        while self.at("__attribute__") or self.at("_Alignas") or self.at("__asm__"):
            self.i += 1
            self.arguments()

    def specifiers(self) -> bool:
        """Storage, qualifiers and one type; false if there is none."""
        typed = seen = False
        while True:
            k = self.s[self.i]
            self.attributes()
            k = self.s[self.i]
            if k in self.QUALIFIERS:
                self.i += 1
            elif k in self.TYPES:
                self.i += 1
                typed = True
            elif not typed and (self.at("struct") or self.at("union")):
                self.i += 1
                self.attributes()
                named = self.take("i")
                if self.take("{"):
                    self.many(self.field, "}", "field")
                    self.need("}")
                elif not named:
                    raise self.bad("a name")
                self.attributes()
                typed = True
            elif not typed and self.take("enum"):
                named = self.take("i")
                if self.take("{"):
                    self.listed(self.enumerator, "}")
                elif not named:
                    raise self.bad("a name")
                typed = True
            elif not typed and k == "i" and (self.s[self.i + 1] in "i*)," or self.s[self.i + 1] in self.QUALIFIERS or seen and self.s[self.i + 1] in "(" and self.s[self.i + 2] == "*"):
                self.i += 1
                typed = True
            else:
                return seen and (typed or k in "i*(")
            seen = True

    def enumerator(self) -> None:
        self.need("i")
        if self.take("="):
            self.expression(2)

    def field(self) -> None:
        if self.take(";"):
            return
        if not self.specifiers():
            raise self.bad("a field")
        while not self.take(";"):
            if not self.at(":"):
                self.declarator()
            if self.take(":"):
                self.expression()
            if not self.take(","):
                self.need(";")
                return

    def declarator(self, abstract: bool = False) -> bool:
        """True if it ends with a parameter list."""
        while self.take("*") or self.take("^"):
            while self.s[self.i] in self.QUALIFIERS:
                self.i += 1
        self.attributes()
        if self.take("i"):
            pass
        elif self.at("(") and (not abstract or self.s[self.i + 1] in "*("):
            self.i += 1
            self.declarator(abstract)
            self.need(")")
        elif not abstract:
            raise self.bad("a declarator")
        function = False
        while True:
            if self.take("["):
                while self.s[self.i] in self.QUALIFIERS:
                    self.i += 1
                if not self.take("]"):
                    self.expression()
                    self.need("]")
            elif self.take("("):
                self.listed(self.parameter, ")")
                function = True
            else:
                self.attributes()
                return function

    def parameter(self) -> None:
        if self.take("..."):
            return
        if not self.specifiers():
            self.need("i")
            return
        self.declarator(abstract=True)

    def declaration(self, external: bool) -> None:
        """After the specifiers."""
        if self.take(";"):
            return
        while True:
            function = self.declarator()
            if function and self.at("{") and external:
                return self.block()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                break
        self.need(";")

    def initializer(self) -> None:
        if not self.take("{"):
            return self.expression()
        while not self.take("}"):
            designated = False
            while self.at(".") or self.at("["):
                designated = True
                if self.take("."):
                    self.need("i")
                else:
                    self.i += 1
                    self.expression()
                    self.need("]")
            if designated:
                self.need("=")
            self.initializer()
            if not self.take(","):
                self.need("}")
                return

    def block(self) -> None:
        self.need("{")
        self.many(self.statement, "}", "statement")
        self.need("}")

    def condition(self) -> None:
        self.need("(")
        self.commas()
        self.need(")")

    def commas(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def declares(self) -> bool:
        k, after = self.s[self.i], self.s[self.i + 1]
        return k in self.QUALIFIERS or k in self.TYPES or k in self.grammar.chars("struct union enum __attribute__") or k == "i" and (after == "i" or after in self.QUALIFIERS)

    def statement(self) -> None:
        c, s, i = self.c, self.s, self.i
        k = s[i]
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k == c["if"]:
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif k in (c["while"], c["switch"]):
            self.i += 1
            self.condition()
            self.statement()
        elif k == c["do"]:
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif k == c["for"]:
            self.i += 1
            self.need("(")
            if self.declares():
                self.specifiers()
                self.declaration(False)
            else:
                if not self.at(";"):
                    self.commas()
                self.need(";")
            if not self.at(";"):
                self.commas()
            self.need(";")
            if not self.at(")"):
                self.commas()
            self.need(")")
            self.statement()
        elif k == c["return"]:
            self.i += 1
            if not self.at(";"):
                self.commas()
            self.need(";")
        elif k in (c["break"], c["continue"]):
            self.i += 1
            self.need(";")
        elif k == c["goto"]:
            self.i += 1
            self.need("i")
            self.need(";")
        elif k == c["case"]:
            self.i += 1
            self.expression()
            if self.take("..."):
                self.expression()
            self.need(":")
            if not self.at("}"):
                self.statement()
        elif k == c["default"] or k == "i" and s[i + 1] == ":":
            self.i += 1
            self.need(":")
            if not self.at("}"):
                self.statement()
        elif k in (c["asm"], c["__asm__"], c["_Static_assert"]):
            self.i += 1
            self.arguments()
            self.need(";")
        elif self.declares():
            self.specifiers()
            self.declaration(False)
        else:
            self.commas()
            self.need(";")

    def primary(self) -> None:
        c, k = self.c, self.s[self.i]
        if k in "in":
            self.i += 1
            if k == "i":
                while self.at("s"):
                    self.i += 1
        elif k == "s":
            while self.s[self.i] in "s" or self.at("i") and self.s[self.i - 1] == "s":
                self.i += 1
        elif k == "(":
            if not self.tries(self.cast):
                self.i += 1
                if self.at("{"):
                    self.block()
                else:
                    self.commas()
                self.need(")")
        elif k in (c["sizeof"], c["_Alignof"]):
            self.i += 1
            if not (self.at("(") and self.tries(self.sized_type)):
                self.unary()
        elif k == c["_Generic"]:
            self.i += 1
            self.arguments()
        else:
            raise self.bad("an expression")

    def sized_type(self) -> None:
        self.need("(")
        self.type_name()
        self.need(")")

    def type_name(self) -> None:
        if self.at("i") and self.ahead(")"):
            self.i += 1
            return
        if not self.specifiers():
            raise self.bad("a type")
        self.declarator(abstract=True)

    def cast(self) -> None:
        self.need("(")
        plain = self.at("i") and self.ahead(")")
        self.type_name()
        self.need(")")
        k = self.s[self.i]
        if k == "{":
            return self.initializer()
        if plain and not (k in "isn" or k == self.c["sizeof"]):
            raise self.bad("an operand")
        self.unary()

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            if self.at("{"):
                self.block()
            elif not self.tries(lambda: self.whole(self.type_name)):
                self.expression()
            if not (self.take(",") or self.take(":")):
                self.need(")")
                return

    def whole(self, rule) -> None:
        rule()
        if self.s[self.i] not in ",)":
            raise self.bad(",")

    def postfix(self) -> None:
        c = self.c
        while True:
            k = self.s[self.i]
            if k == "." or k == c["->"]:
                self.i += 1
                self.need("i")
            elif k == "(":
                self.arguments()
            elif k == "[":
                self.i += 1
                self.commas()
                self.need("]")
            elif k in (c["++"], c["--"]):
                self.i += 1
            else:
                return
