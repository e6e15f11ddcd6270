"""Grammar of Java source files."""

from __future__ import annotations

import re

from waymark.llm.syntax.base import Bad, Cursor, Tok

ESC = r"\\(?:[btnfrs0-7\"'\\]|u+[\da-fA-F]{4})"
TOKEN = re.compile(
    r"\s*+(?:(?P<lc>//[^\n\r]*)|(?P<bc>/\*[\s\S]*?\*/)"
    r"|(?P<txt>\"\"\"[ \t\f]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\")"
    rf"|(?P<str>\"(?:[^\"\\\n\r]|{ESC})*\"|'(?:[^'\\\n\r]|{ESC})')"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?)(?![\w$])"
    r"|(?P<id>[^\W\d]\w*(?:\$\w*)*|\$[\w$]*)"
    r"|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[=<>!~?:+\-*/&|^%(){}\[\];,.@])|(?P<end>\Z))"
)
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new"
    " package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
PRIMITIVE = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())


def tokens(text: str) -> list[Tok]:
    out: list[Tok] = []
    line, at, n = 1, 1 if text[:1] == "\ufeff" else 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        if m is None:
            if text[at:].lstrip() == "\x1a":
                break
            raise Bad(line + text.count("\n", at) - text[at:].lstrip().count("\n"), f"illegal character {text[at:].lstrip()[:1]!r}")
        kind, end = m.lastgroup, m.end()
        if kind not in ("lc", "bc", "end"):
            v = m[kind]
            line += text.count("\n", at, end - len(v))
            out.append(Tok("str" if kind == "txt" else kind, v, line, False))
            if kind == "txt":
                line += v.count("\n")
        else:
            line += text.count("\n", at, end)
        at = end
    out.append(Tok("eof", "", line, True))
    return out


class Java(Cursor):
    def ident(self) -> None:
        c = self.cur
        if c.kind != "id" or c.value in KEYWORDS:
            self.fail("expected name")
        self.i += 1

    def is_ident(self) -> bool:
        return self.cur.kind == "id" and self.cur.value not in KEYWORDS

    def qualified(self) -> None:
        self.ident()
        while self.op(".") and self.peek().kind == "id" and self.peek().value not in KEYWORDS:
            self.next()
            self.next()

    def file(self) -> None:
        mark = self.i
        self.modifiers()
        if self.eat("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = mark
        while self.at("import") or self.op(";"):
            if self.eat(";"):
                continue
            self.next()
            self.eat("static")
            self.qualified()
            if self.eat("."):
                self.need("*")
            self.need(";")
        if self.at("module", "open") and self.peek().kind == "id":
            while self.cur.kind != "eof":
                self.next()
            return
        while self.cur.kind != "eof":
            if not self.eat(";"):
                self.modifiers()
                if not self.type_decl():
                    self.fail("expected type declaration")

    def modifiers(self) -> None:
        while True:
            if self.op("@") and self.peek().value != "interface":
                self.next()
                self.qualified()
                if self.op("("):
                    self.annotation_args()
            elif self.cur.kind == "id" and self.cur.value in MODIFIERS and self.peek().value not in (":", "->", "=", ".", ";") and not (self.cur.value == "synchronized" and self.peek().value == "("):
                self.next()
            elif self.at("non") and self.peek().value == "-" and self.peek(2).value == "sealed":
                self.i += 3
            else:
                return

    def annotation_args(self) -> None:
        self.need("(")
        while not self.op(")"):
            if self.is_ident() and self.peek().value == "=":
                self.next()
                self.next()
            self.element_value()
            if not self.eat(","):
                break
        self.need(")")

    def element_value(self) -> None:
        if self.op("{"):
            self.next()
            while not self.op("}"):
                self.element_value()
                if not self.eat(","):
                    break
            self.need("}")
        elif self.op("@"):
            self.modifiers()
        else:
            self.conditional()

    def type_decl(self) -> bool:
        c = self.cur
        if self.op("@"):
            self.next()
            self.need("interface")
            self.ident()
            self.body()
            return True
        if c.kind != "id":
            return False
        if c.value == "class":
            self.next()
            self.ident()
            self.type_params()
            if self.eat("extends"):
                self.type_()
            self.type_lists()
            self.body()
            return True
        if c.value == "interface":
            self.next()
            self.ident()
            self.type_params()
            self.type_lists()
            self.body()
            return True
        if c.value == "enum":
            self.next()
            self.ident()
            self.type_lists()
            self.enum_body()
            return True
        if c.value == "record" and self.peek().kind == "id" and self.peek(2).value in ("(", "<"):
            self.next()
            self.ident()
            self.type_params()
            self.params()
            self.type_lists()
            self.body()
            return True
        return False

    def type_lists(self) -> None:
        while self.eat("implements", "extends", "permits"):
            self.type_()
            while self.eat(","):
                self.type_()

    def type_params(self) -> None:
        if self.op("<"):
            self.next()
            while True:
                self.modifiers()
                self.ident()
                if self.eat("extends"):
                    self.type_()
                    while self.eat("&"):
                        self.type_()
                if not self.eat(","):
                    break
            if not self.split(">"):
                self.fail()

    def enum_body(self) -> None:
        self.need("{")
        while self.is_ident() or self.op("@"):
            self.modifiers()
            self.ident()
            if self.op("("):
                self.args()
            if self.op("{"):
                self.body()
            if not self.eat(","):
                break
        if self.eat(";"):
            while not self.op("}"):
                self.member()
        self.need("}")

    def body(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.member()
        self.next()

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.op("{") or (self.at("static") and self.peek().value == "{"):
            self.eat("static")
            return self.block()
        self.modifiers()
        if self.type_decl():
            return
        self.type_params()
        if self.is_ident() and self.peek().value in ("(", "{"):
            self.ident()
            if self.op("("):
                self.params()
            return self.method_rest(False)
        if not self.eat("void"):
            self.type_()
        self.ident()
        if self.op("("):
            self.params()
            self.dims()
            return self.method_rest(True)
        self.declarators()
        self.need(";")

    def method_rest(self, bare: bool) -> None:
        if self.eat("throws"):
            self.type_()
            while self.eat(","):
                self.type_()
        if self.eat("default"):
            self.element_value()
        if bare and self.eat(";"):
            return
        self.block()

    def dims(self) -> None:
        while self.op("[") and self.peek().value == "]":
            self.next()
            self.next()

    def declarators(self) -> None:
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.ident()

    def initializer(self) -> None:
        if self.op("{"):
            self.next()
            while not self.op("}"):
                self.initializer()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.expression()

    def params(self) -> None:
        self.need("(")
        while not self.op(")"):
            self.modifiers()
            self.type_()
            self.modifiers()
            self.eat("...")
            if self.at("this"):
                self.next()
            else:
                self.ident()
            self.dims()
            if not self.eat(","):
                break
        self.need(")")

    def type_(self) -> None:
        self.modifiers_annotations()
        if self.cur.kind == "id" and self.cur.value in PRIMITIVE:
            self.next()
        else:
            while True:
                self.ident()
                if self.op("<"):
                    self.type_args()
                if not (self.op(".") and self.peek().kind == "id" and self.peek().value not in KEYWORDS):
                    break
                self.next()
        self.modifiers_annotations()
        self.dims()

    def modifiers_annotations(self) -> None:
        while self.op("@") and self.peek().value != "interface":
            self.next()
            self.qualified()
            if self.op("("):
                self.annotation_args()

    def type_args(self) -> None:
        self.split("<")
        if self.split(">") if self.op(">") else False:
            return
        while True:
            if self.eat("?"):
                if self.eat("extends", "super"):
                    self.type_()
            else:
                self.type_()
            if not self.eat(","):
                break
        if not self.split(">"):
            self.fail("type arguments not closed")

    def tries(self, f) -> bool:  # noqa: ANN001
        mark, toks = self.i, None
        if any(t.value in (">>", ">>>") for t in self.t[mark : mark + 40]):
            toks = list(self.t)
        try:
            if f():
                return True
        except Bad:
            pass
        self.i = mark
        if toks is not None:
            self.t = toks
        return False

    # statements
    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement()
        self.next()

    def declaration_ahead(self) -> bool:
        def ahead() -> bool:
            self.type_()
            self.ident()
            return self.op("=", ";", ",", ":", "[")

        mark = self.i
        toks = list(self.t) if any(t.value in (">>", ">>>") for t in self.t[mark : mark + 40]) else None
        got = self.tries(ahead)
        self.i = mark
        if toks is not None:
            self.t = toks
        return got

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        c = self.cur
        if c.kind == "op":
            if c.value == "{":
                return self.block()
            if c.value == ";":
                self.next()
                return None
        v = c.value if c.kind == "id" else ""
        if v == "if":
            self.next()
            self.paren()
            self.statement()
            if self.eat("else"):
                self.statement()
            return None
        if v == "while":
            self.next()
            self.paren()
            return self.statement()
        if v == "do":
            self.next()
            self.statement()
            self.need("while")
            self.paren()
            self.need(";")
            return None
        if v == "for":
            self.next()
            self.need("(")
            if not self.op(";"):
                self.modifiers()
                if self.declaration_ahead():
                    self.type_()
                    self.ident()
                    if self.eat(":"):
                        self.expression()
                        self.need(")")
                        return self.statement()
                    self.declarators()
                else:
                    self.expressions()
            self.need(";")
            if not self.op(";"):
                self.expression()
            self.need(";")
            if not self.op(")"):
                self.expressions()
            self.need(")")
            return self.statement()
        if v in ("return", "throw"):
            self.next()
            if v == "throw" or not self.op(";"):
                self.expression()
            self.need(";")
            return None
        if v in ("break", "continue"):
            self.next()
            if self.is_ident():
                self.next()
            self.need(";")
            return None
        if v == "yield" and self.peek().value not in ("=", ".", "(", "++", "--"):
            self.next()
            self.expression()
            self.need(";")
            return None
        if v == "assert":
            self.next()
            self.expression()
            if self.eat(":"):
                self.expression()
            self.need(";")
            return None
        if v == "synchronized":
            self.next()
            self.paren()
            return self.block()
        if v == "switch":
            self.switch_()
            return None
        if v == "try":
            return self.try_()
        if self.is_ident() and self.peek().value == ":" and self.peek().kind == "op":
            self.next()
            self.next()
            return self.statement()
        if v in ("class", "interface", "enum") or v in ("abstract", "final", "static") or self.op("@") or (v == "record" and self.peek().kind == "id" and self.peek(2).value in ("(", "<")):
            self.modifiers()
            if self.type_decl():
                return None
        if self.declaration_ahead():
            self.type_()
            self.ident()
            self.declarators()
            self.need(";")
            return None
        start = self.i
        self.expression()
        last = [t.value for t in self.t[start : self.i] if t.kind == "op"]
        if not any(x in ASSIGN or x in ("++", "--", "(") for x in last):
            self.fail("not a statement")
        self.need(";")
        return None

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def switch_(self) -> None:
        self.need("switch")
        self.paren()
        self.need("{")
        while not self.op("}"):
            if self.eat("case"):
                while True:
                    if self.eat("default"):
                        pass
                    elif not self.tries(self.case_pattern):
                        self.conditional()
                    if not self.eat(","):
                        break
                if self.eat("when"):
                    self.expression()
            elif not self.eat("default"):
                self.fail("expected case")
            if self.eat("->"):
                if self.op("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}"):
                    self.statement()
        self.next()

    def case_pattern(self) -> bool:
        self.type_()
        if self.op("("):
            self.next()
            while not self.op(")"):
                self.case_pattern()
                if not self.eat(","):
                    break
            self.need(")")
            if self.is_ident() and not self.at("when"):
                self.next()
            return self.op("->", ":", ",", ")") or self.at("when")
        self.ident()
        return self.op("->", ":", ",", ")") or self.at("when")

    def try_(self) -> None:
        self.need("try")
        some = self.op("(")
        if some:
            self.next()
            while not self.op(")"):
                self.modifiers()
                if self.declaration_ahead():
                    self.type_()
                    self.ident()
                    self.need("=")
                self.expression()
                if not self.eat(";"):
                    break
            self.need(")")
        self.block()
        while self.eat("catch"):
            some = True
            self.need("(")
            self.modifiers()
            self.type_()
            while self.eat("|"):
                self.type_()
            self.ident()
            self.need(")")
            self.block()
        if self.eat("finally"):
            some = True
            self.block()
        if not some:
            self.fail("try without catch")

    # expressions
    def expression(self) -> None:
        if self.lambda_ahead():
            if self.op("("):
                self.next()
                while not self.op(")"):
                    if self.is_ident() and self.peek().value in (",", ")"):
                        self.ident()
                    elif self.at("_"):
                        self.next()
                    else:
                        self.modifiers()
                        self.type_()
                        self.eat("...")
                        self.ident()
                        self.dims()
                    if not self.eat(","):
                        break
                self.need(")")
            else:
                self.next()
            self.need("->")
            if self.op("{"):
                self.block()
            else:
                self.expression()
            return
        self.conditional()
        if self.cur.kind == "op" and self.cur.value in ASSIGN:
            self.next()
            self.expression()
        elif self.op(">") and self.peek().value in (">=",) and not self.peek().nl:
            self.next()
            self.next()
            self.expression()

    def lambda_ahead(self) -> bool:
        if self.cur.kind == "id":
            return self.peek().value == "->" and self.peek().kind == "op"
        if not self.op("("):
            return False
        return self.t[min(self.closing(self.i) + 1, len(self.t) - 1)].value == "->"

    def conditional(self) -> None:
        self.binary(0)
        if self.eat("?"):
            self.expression()
            self.need(":")
            if self.lambda_ahead():
                self.expression()
            else:
                self.conditional()

    def binary(self, least: int) -> None:
        self.unary()
        while True:
            c = self.cur
            v = c.value
            if c.kind == "op" and v == ">" and self.peek().value == ">" and self.peek().kind == "op":
                v = ">>"
            p = BINARY.get(v, 0) if c.kind in ("op", "id") else 0
            if p <= least:
                return
            self.next()
            if v == ">>":
                self.next()
                if self.op(">"):
                    self.next()
                if self.op("="):
                    self.next()
                    return self.expression()
            if v == "instanceof":
                self.eat("final")
                if not self.tries(self.case_pattern):
                    self.type_()
                    if self.op("("):
                        self.i -= 1
                        self.case_pattern()
                    elif self.is_ident():
                        self.next()
            else:
                self.binary(p)

    def unary(self) -> None:
        if self.op("+", "-", "!", "~", "++", "--"):
            self.next()
            return self.unary()
        if self.op("(") and self.tries(self.cast):
            return None
        self.primary()
        while self.op("++", "--"):
            self.next()
        return None

    def cast(self) -> bool:
        self.need("(")
        simple = self.cur.kind == "id" and self.cur.value in PRIMITIVE
        self.type_()
        while self.eat("&"):
            self.type_()
        self.need(")")
        c = self.cur
        if simple and self.t[self.i - 2].value != "]":
            self.unary()
            return True
        if c.kind in ("str", "num") or self.op("(", "!", "~") or (c.kind == "id" and (c.value not in KEYWORDS or c.value in ("this", "super", "new", "true", "false", "null", "switch"))):
            if self.lambda_ahead():
                self.expression()
            else:
                self.unary()
            return True
        return False

    def args(self) -> None:
        self.need("(")
        while not self.op(")"):
            self.expression()
            if not self.eat(","):
                break
        self.need(")")

    def primary(self) -> None:
        c = self.cur
        if c.kind in ("num", "str"):
            self.next()
        elif self.op("("):
            self.next()
            self.expression()
            self.need(")")
        elif self.at("this", "super"):
            self.next()
            if self.op("("):
                self.args()
        elif self.at("true", "false", "null"):
            self.next()
        elif self.at("new"):
            self.creator()
        elif self.at("switch"):
            self.switch_()
        elif self.at("void"):
            self.next()
            self.need(".")
            self.need("class")
        elif c.kind == "id" and c.value in PRIMITIVE:
            self.next()
            self.dims()
            if not self.op("::"):
                self.need(".")
                self.need("class")
        elif self.is_ident():
            if self.tries(self.typed_ref):
                pass
            else:
                self.next()
                if self.op("("):
                    self.args()
        else:
            self.fail("expected expression")
        while True:
            if self.op("."):
                self.next()
                if self.at("new"):
                    self.creator()
                    continue
                if self.op("<"):
                    self.type_args()
                if not self.eat("class", "this", "super"):
                    self.ident()
                if self.op("("):
                    self.args()
            elif self.op("["):
                self.next()
                self.expression()
                self.need("]")
            elif self.op("::"):
                self.next()
                if self.op("<"):
                    self.type_args()
                if not self.eat("new"):
                    self.ident()
            else:
                return

    def typed_ref(self) -> bool:
        if not (self.peek().kind == "op" and self.peek().value in ("<", "[", ".")):
            return False
        self.type_()
        if self.t[self.i - 1].value not in (">", "]"):
            return False
        if self.op("::"):
            return True
        if self.op(".") and self.peek().value == "class":
            self.next()
            self.next()
            return True
        return False

    def creator(self) -> None:
        self.need("new")
        if self.op("<"):
            self.type_args()
        self.modifiers_annotations()
        if self.cur.kind == "id" and self.cur.value in PRIMITIVE:
            self.next()
        else:
            while True:
                self.ident()
                if self.op("<"):
                    self.type_args()
                if not self.eat("."):
                    break
        if self.op("["):
            filled = False
            while self.op("["):
                self.next()
                if not self.op("]"):
                    self.expression()
                    filled = True
                self.need("]")
            if self.op("{") and not filled:
                self.initializer()
            return
        self.args()
        if self.op("{"):
            self.body()


def check(text: str) -> None:
    Java(tokens(text)).file()
