"""Grammar of Go source files."""

from __future__ import annotations

import re

from waymark.llm.syntax.base import Bad, Cursor, Tok

TOKEN = re.compile(
    r"[ \t\r]*+(?:(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*[\s\S]*?\*/)"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)i?)(?!\w)"
    r"|(?P<id>[^\W\d]\w*)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\(?:[abfnrtv\\'\"]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))')"
    r"|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~])|(?P<end>\Z))"
)
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


def tokens(text: str) -> list[Tok]:
    out: list[Tok] = []
    line, at, n = 1, 1 if text[:1] == "\ufeff" else 0, len(text)

    def newline() -> None:
        if out and out[-1].value != ";" and (out[-1].kind in ("num", "str") or (out[-1].kind == "id" and (out[-1].value not in KEYWORDS or out[-1].value in ENDS)) or (out[-1].kind == "op" and out[-1].value in ENDS)):
            out.append(Tok("op", ";", line, True))

    while at < n:
        m = TOKEN.match(text, at)
        if m is None:
            raise Bad(line, f"illegal character {text[at:].lstrip()[:1]!r}")
        kind = m.lastgroup
        v, at = m[kind], m.end()
        if kind == "nl":
            newline()
            line += 1
        elif kind == "bc":
            k = v.count("\n")
            if k:
                newline()
            line += k
        elif kind not in ("lc", "end"):
            out.append(Tok(kind, v, line, False))
            if kind == "str":
                line += v.count("\n")
    newline()
    out.append(Tok("eof", "", line, True))
    return out


class Go(Cursor):
    level = 0

    def ident(self) -> None:
        c = self.cur
        if c.kind != "id" or c.value in KEYWORDS:
            self.fail("expected name")
        self.i += 1

    def is_ident(self) -> bool:
        return self.cur.kind == "id" and self.cur.value not in KEYWORDS

    def semi(self) -> None:
        if self.op(")", "}"):
            return
        if self.cur.kind == "eof" or not self.eat(";"):
            self.fail("statement not ended")

    def file(self) -> None:
        self.need("package")
        self.ident()
        self.semi()
        while self.at("import"):
            self.next()
            self.group(self.import_spec)
            self.semi()
        while self.cur.kind != "eof":
            if self.eat(";"):
                continue
            if self.at("func"):
                self.func_decl()
            elif self.at("var", "const", "type"):
                self.decl()
            else:
                self.fail("expected declaration")
            self.semi()

    def group(self, spec) -> None:  # noqa: ANN001
        if self.eat("("):
            while not self.op(")"):
                spec()
                self.semi()
            self.next()
        else:
            spec()

    def import_spec(self) -> None:
        if self.is_ident() or self.op("."):
            self.next()
        if self.next().kind != "str":
            self.i -= 1
            self.fail("expected path")

    def decl(self) -> None:
        kind = self.next().value
        self.group({"var": self.value_spec, "const": self.const_spec, "type": self.type_spec}[kind])

    def names(self) -> None:
        self.ident()
        while self.eat(","):
            self.ident()

    def value_spec(self) -> None:
        self.names()
        typed = not self.op("=")
        if typed:
            self.type_()
        if self.eat("="):
            self.exprs()

    def const_spec(self) -> None:
        self.names()
        if not self.op("=", ";", ")"):
            self.type_()
        if self.eat("="):
            self.exprs()

    def type_spec(self) -> None:
        self.ident()
        if self.op("[") and self.peek().kind == "id" and self.peek(2).value != "]":
            self.type_params()
        self.eat("=")
        self.type_()

    def type_params(self) -> None:
        self.need("[")
        while not self.op("]"):
            self.names()
            self.constraint()
            if not self.eat(","):
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type_()
            if not self.eat("|"):
                return

    def func_decl(self) -> None:
        self.need("func")
        if self.op("("):
            self.params()
        self.ident()
        if self.op("["):
            self.type_params()
        self.signature()
        if self.op("{"):
            self.body()

    def body(self) -> None:
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def signature(self) -> None:
        self.params()
        if self.op("("):
            self.params()
        elif self.type_ahead():
            self.type_()

    def type_ahead(self) -> bool:
        c = self.cur
        return (c.kind == "id" and (c.value not in KEYWORDS or c.value in ("func", "map", "chan", "struct", "interface"))) or self.op("*", "[", "(", "<-")

    def params(self) -> None:
        self.need("(")
        while not self.op(")"):
            if self.eat("..."):
                self.type_()
            else:
                self.type_()
                if not self.op(",", ")"):
                    self.eat("...")
                    self.type_()
            if not self.eat(","):
                break
        self.need(")")

    def type_(self) -> None:
        c = self.cur
        if self.is_ident():
            self.next()
            if self.eat("."):
                self.ident()
            if self.op("[") and self.peek().value != "]" and self.peek().kind == "id" and self.level >= 0:
                mark = self.i
                try:
                    self.next()
                    self.type_()
                    while self.eat(","):
                        self.type_()
                    self.need("]")
                except Bad:
                    self.i = mark
            return
        if self.eat("*", "chan"):
            if c.value == "chan":
                self.eat("<-")
            return self.type_()
        if self.eat("<-"):
            self.need("chan")
            return self.type_()
        if self.eat("("):
            self.type_()
            self.need(")")
            return
        if self.eat("["):
            if not self.op("]") and not self.eat("..."):
                self.expr()
            self.need("]")
            return self.type_()
        if self.eat("map"):
            self.need("[")
            self.type_()
            self.need("]")
            return self.type_()
        if self.eat("func"):
            return self.signature()
        if self.eat("struct"):
            self.need("{")
            while not self.op("}"):
                if self.op("*"):
                    self.type_()
                elif self.peek().value in (";", "}", ".") or self.peek().kind == "str":
                    self.type_()
                else:
                    self.names()
                    self.type_()
                if self.cur.kind == "str":
                    self.next()
                self.semi()
            self.next()
            return
        if self.eat("interface"):
            self.need("{")
            while not self.op("}"):
                if self.is_ident() and self.peek().value == "(":
                    self.next()
                    self.signature()
                else:
                    self.constraint()
                self.semi()
            self.next()
            return
        self.fail("expected type")

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement()
            self.semi()
        self.next()

    def statement(self) -> None:
        c = self.cur
        if c.kind == "op" and c.value == "{":
            return self.block()
        if c.kind == "op" and c.value == ";":
            return None
        v = c.value if c.kind == "id" else ""
        if v in ("var", "const", "type"):
            return self.decl()
        if v == "if":
            return self.if_()
        if v == "for":
            return self.for_()
        if v in ("switch", "select"):
            return self.switch_()
        if v == "return":
            self.next()
            if not self.op(";", "}"):
                self.exprs()
            return None
        if v in ("go", "defer"):
            self.next()
            self.expr()
            return None
        if v in ("break", "continue", "goto"):
            self.next()
            if self.is_ident():
                self.next()
            return None
        if v == "fallthrough":
            self.next()
            return None
        if self.is_ident() and self.peek().value == ":" and self.peek().kind == "op":
            self.next()
            self.next()
            if not self.op("}"):
                self.statement()
            return None
        return self.simple()

    def simple(self, ranged: bool = False) -> bool:
        if ranged and self.eat("range"):
            self.expr()
            return True
        self.exprs()
        if self.op("++", "--"):
            self.next()
        elif self.cur.kind == "op" and self.cur.value in ASSIGN:
            self.next()
            if ranged and self.eat("range"):
                self.expr()
                return True
            self.exprs()
        elif self.eat("<-"):
            self.expr()
        return False

    def header(self) -> None:
        level, self.level = self.level, -1
        if not self.op("{"):
            if not self.op(";"):
                self.simple()
            if self.eat(";") and not self.op("{"):
                self.simple()
        self.level = level

    def if_(self) -> None:
        self.need("if")
        if self.op("{"):
            self.fail("missing condition")
        self.header()
        self.block()
        if self.eat("else"):
            if self.at("if"):
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.need("for")
        level, self.level = self.level, -1
        if not self.op("{"):
            ranged = False
            if not self.op(";"):
                ranged = self.simple(True)
            if not ranged and self.eat(";"):
                if not self.op(";"):
                    self.expr()
                self.need(";")
                if not self.op("{"):
                    self.simple()
        self.level = level
        self.block()

    def switch_(self) -> None:
        kind = self.next().value
        if kind == "switch":
            self.header()
        self.need("{")
        while not self.op("}"):
            if self.eat("case"):
                if kind == "select":
                    self.simple()
                else:
                    self.type_or_expr()
                    while self.eat(","):
                        self.type_or_expr()
            elif not self.eat("default"):
                self.fail("expected case")
            self.need(":")
            level, self.level = self.level, 0
            while not self.at("case", "default", "}"):
                self.statement()
                if not self.at("case", "default", "}"):
                    self.semi()
            self.level = level
        self.next()

    def type_or_expr(self) -> None:
        if self.op("[") or self.at("map", "chan", "func", "struct", "interface"):
            mark = self.i
            try:
                self.type_()
                if self.op(",", ":"):
                    return
            except Bad:
                pass
            self.i = mark
        self.expr()

    def exprs(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def expr(self, least: int = 0) -> None:
        self.unary()
        while self.cur.kind == "op" and (p := BINARY.get(self.cur.value, 0)) > least:
            self.next()
            self.expr(p)

    def unary(self) -> None:
        if self.op("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.next()
            if self.at("chan"):
                self.i -= 1
                return self.type_()
            return self.unary()
        return self.primary()

    def primary(self) -> None:
        c = self.cur
        literal = False
        if c.kind in ("num", "str"):
            self.next()
        elif c.kind == "op" and c.value == "(":
            self.next()
            level, self.level = self.level, 0
            self.type_or_expr()
            self.level = level
            self.need(")")
        elif self.at("func"):
            self.next()
            self.signature()
            if self.op("{"):
                self.body()
        elif (c.kind == "op" and c.value == "[") or self.at("map", "chan", "struct", "interface"):
            self.type_()
            literal = True
        elif self.is_ident():
            self.next()
            literal = self.level >= 0
        else:
            self.fail("expected expression")
        while True:
            if self.op("."):
                self.next()
                if self.eat("("):
                    if not self.eat("type"):
                        self.type_()
                    self.need(")")
                    literal = False
                else:
                    self.ident()
            elif self.op("("):
                level, self.level = self.level, 0
                self.next()
                while not self.op(")"):
                    self.type_or_expr()
                    self.eat("...")
                    if not self.eat(","):
                        break
                self.need(")")
                self.level = level
                literal = False
            elif self.op("["):
                level, self.level = self.level, 0
                self.next()
                if not self.op(":"):
                    self.type_or_expr()
                    while self.eat(","):
                        self.type_()
                while self.eat(":"):
                    if not self.op("]", ":"):
                        self.expr()
                self.need("]")
                self.level = level
            elif self.op("{") and literal:
                self.literal()
                literal = False
            else:
                return

    def literal(self) -> None:
        self.need("{")
        level, self.level = self.level, 0
        while not self.op("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if not self.eat(","):
                break
        self.need("}")
        self.level = level

    def element(self) -> None:
        if self.op("{"):
            self.literal()
        else:
            self.expr()


def check(text: str) -> None:
    Go(tokens(text)).file()
