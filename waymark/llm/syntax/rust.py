"""Grammar of Rust source files."""

from __future__ import annotations

import re

from waymark.llm.syntax.base import Bad, Cursor, Tok

TOKEN = re.compile(
    r"\s*+(?:(?P<lc>//[^\n]*)|(?P<bc>/\*)"
    r"|(?P<raw>(?:b|c)?r(?P<h>#*)\"[\s\S]*?\"(?P=h))|(?P<str>(?:b|c)?\"(?:[^\"\\]|\\[\s\S])*\")"
    r"|(?P<chr>b?'(?:[^'\\\n]|\\(?:[nrt\\0'\"]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\}))')|(?P<life>'[^\W\d]\w*)"
    r"|(?P<num>0x[\da-fA-F_]+(?:[ui](?:8|16|32|64|128|size))?|0b[01_]+(?:[ui](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[ui](?:8|16|32|64|128|size))?"
    r"|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?(?:[ui](?:8|16|32|64|128|size)|f32|f64)?)(?!\w)"
    r"|(?P<id>(?:r\#)?[^\W\d]\w*)"
    r"|(?P<op><<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[+\-*/%^!&|=<>@.,;:#$?~()\[\]{}])|(?P<end>\Z))"
)
KEYWORDS = frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split())
PATH_WORDS = frozenset("self Self super crate".split())
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "|": 4, "^": 5, "&": 6, "<<": 7, ">>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
CLOSER = {"(": ")", "[": "]", "{": "}"}


def tokens(text: str) -> list[Tok]:
    out: list[Tok] = []
    line, at, n = 1, 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        m = TOKEN.match(text, at)
        if m is None:
            raise Bad(line + text.count("\n", at) - text[at:].lstrip().count("\n"), f"illegal character {text[at:].lstrip()[:1]!r}")
        kind, end = m.lastgroup, m.end()
        if kind == "h":
            kind = "raw"
        v = m[kind]
        line += text.count("\n", at, end - len(v))
        at = end
        if kind == "bc":
            depth = 1
            while depth:
                k = re.compile(r"/\*|\*/").search(text, at)
                if k is None:
                    raise Bad(line, "unterminated comment")
                depth += 1 if k.group() == "/*" else -1
                line += text.count("\n", at, k.end())
                at = k.end()
            continue
        if kind not in ("lc", "end"):
            out.append(Tok("str" if kind in ("raw", "chr") else kind, v, line, False))
            if kind in ("str", "raw"):
                line += v.count("\n")
    out.append(Tok("eof", "", line, True))
    return out


class Rust(Cursor):
    def ident(self) -> None:
        c = self.cur
        if c.kind != "id" or c.value in KEYWORDS:
            self.fail("expected name")
        self.i += 1

    def is_ident(self) -> bool:
        return self.cur.kind == "id" and self.cur.value not in KEYWORDS

    def file(self) -> None:
        while self.op("#") and self.peek().value == "!":
            self.attribute()
        while self.cur.kind != "eof":
            self.item()

    def attribute(self) -> None:
        self.need("#")
        self.eat("!")
        if not self.op("["):
            self.fail("expected attribute")
        self.tree()

    def attributes(self) -> None:
        while self.op("#"):
            self.attribute()

    def tree(self) -> None:
        """A balanced run of any tokens."""
        c = self.cur
        close = CLOSER.get(c.value) if c.kind == "op" else None
        if close is None:
            self.fail("expected bracket")
        self.next()
        while not self.op(close):
            if self.cur.kind == "eof" or self.op(")", "]", "}"):
                self.fail("not balanced")
            if self.op("(", "[", "{"):
                self.tree()
            else:
                self.next()
        self.next()

    def visibility(self) -> None:
        if self.eat("pub") and self.op("(") and self.peek().value in ("crate", "super", "self", "in"):
            self.tree()

    def item(self) -> None:
        self.attributes()
        self.visibility()
        c = self.cur
        v = c.value if c.kind == "id" else ""
        if v == "use":
            self.next()
            self.use_tree()
            self.need(";")
        elif v == "mod":
            self.next()
            self.ident()
            if not self.eat(";"):
                self.need("{")
                while not self.eat("}"):
                    self.item()
        elif v in ("fn", "async", "unsafe", "extern") or (v == "const" and self.peek().value in ("fn", "unsafe", "async", "extern")):
            if v == "extern" and self.peek().value == "crate":
                self.next()
                self.next()
                self.next()
                if self.eat("as"):
                    self.next()
                self.need(";")
                return
            while self.at("const", "async", "unsafe", "extern"):
                self.next()
                if self.cur.kind == "str":
                    self.next()
            if self.at("impl"):
                return self.impl()
            if self.at("trait"):
                return self.trait()
            if self.op("{"):
                self.next()
                while not self.eat("}"):
                    self.item()
                return
            self.function()
        elif v == "struct":
            self.next()
            self.ident()
            self.generics()
            self.where()
            if self.op("("):
                self.tuple_fields()
                self.where()
                self.need(";")
            elif not self.eat(";"):
                self.fields()
        elif v == "union" and self.peek().kind == "id":
            self.next()
            self.ident()
            self.generics()
            self.fields()
        elif v == "enum":
            self.next()
            self.ident()
            self.generics()
            self.where()
            self.need("{")
            while not self.op("}"):
                self.attributes()
                self.ident()
                if self.op("("):
                    self.tuple_fields()
                elif self.op("{"):
                    self.fields()
                if self.eat("="):
                    self.expr()
                if not self.eat(","):
                    break
            self.need("}")
        elif v == "trait":
            self.trait()
        elif v == "impl":
            self.impl()
        elif v in ("const", "static"):
            self.next()
            self.eat("mut")
            if not self.eat("_"):
                self.ident()
            self.need(":")
            self.type_()
            if self.eat("="):
                self.expr()
            self.need(";")
        elif v == "type":
            self.next()
            self.ident()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type_()
            self.where()
            self.need(";")
        elif self.is_ident() or v in PATH_WORDS:
            self.path(False)
            self.need("!")
            if self.is_ident():
                self.next()
            brace = self.op("{")
            self.tree()
            if not brace:
                self.need(";")
        else:
            self.fail("expected item")

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                while not self.op("}"):
                    self.use_tree()
                    if not self.eat(","):
                        break
                self.need("}")
                return
            if self.cur.kind != "id" or (self.cur.value in KEYWORDS and self.cur.value not in PATH_WORDS):
                self.fail("expected path")
            self.next()
            if self.eat("as"):
                if self.next().kind != "id":
                    self.fail()
                return
            if not self.eat("::"):
                return

    def fields(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.attributes()
            self.visibility()
            self.ident()
            self.need(":")
            self.type_()
            if not self.eat(","):
                break
        self.need("}")

    def tuple_fields(self) -> None:
        self.need("(")
        while not self.op(")"):
            self.attributes()
            self.visibility()
            self.type_()
            if not self.eat(","):
                break
        self.need(")")

    def trait(self) -> None:
        self.need("trait")
        self.ident()
        self.generics()
        if self.eat(":"):
            self.bounds()
        self.where()
        self.members()

    def impl(self) -> None:
        self.need("impl")
        if self.op("<"):
            self.generics()
        self.eat("!")
        self.type_()
        if self.eat("for"):
            self.type_()
        self.where()
        self.members()

    def members(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.op("#") and self.peek().value == "!":
                self.attribute()
            else:
                self.item()

    def function(self) -> None:
        self.need("fn")
        self.ident()
        self.generics()
        self.need("(")
        while not self.op(")"):
            self.attributes()
            if self.op("...") or (self.op("&") and (self.peek().value in ("self", "mut") or self.peek().kind == "life")) or self.at("self") or (self.at("mut") and self.peek().value == "self"):
                while not self.op(",", ")", ":"):
                    if self.cur.kind == "eof":
                        self.fail()
                    self.next()
                if self.eat(":"):
                    self.type_()
            else:
                self.pattern()
                self.need(":")
                self.type_()
            if not self.eat(","):
                break
        self.need(")")
        if self.eat("->"):
            self.type_()
        self.where()
        if not self.eat(";"):
            self.block()

    def generics(self) -> None:
        if not self.op("<"):
            return
        self.next()
        while not self.op(">"):
            self.attributes()
            if self.cur.kind == "life":
                self.next()
                if self.eat(":"):
                    self.bounds()
            elif self.eat("const"):
                self.ident()
                self.need(":")
                self.type_()
                if self.eat("="):
                    self.unary()
            else:
                self.ident()
                if self.eat(":"):
                    self.bounds()
                if self.eat("="):
                    self.type_()
            if not self.eat(","):
                break
        if not self.split(">"):
            self.fail()

    def where(self) -> None:
        if self.eat("where"):
            while not self.op("{", ";", "="):
                if self.cur.kind == "life":
                    self.next()
                else:
                    self.for_life()
                    self.type_()
                self.need(":")
                self.bounds()
                if not self.eat(","):
                    break

    def for_life(self) -> None:
        if self.at("for") and self.peek().value == "<":
            self.next()
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.cur.kind == "life":
                self.next()
            elif self.op("?", "(", "::", "~") or self.cur.kind == "id":
                paren = self.eat("(")
                self.eat("?")
                self.for_life()
                self.path(False)
                if paren:
                    self.need(")")
            else:
                return
            if not self.eat("+"):
                return

    def path(self, expr: bool) -> None:
        if self.split("<") if self.op("<", "<<") else False:
            self.type_()
            if self.eat("as"):
                self.path(False)
            if not self.split(">"):
                self.fail()
            self.need("::")
        else:
            self.eat("::")
        while True:
            c = self.cur
            if c.kind != "id" or (c.value in KEYWORDS and c.value not in PATH_WORDS):
                self.fail("expected path")
            self.next()
            if not expr:
                if self.op("::") and self.peek().value in ("<", "<<"):
                    self.next()
                if self.op("<", "<<"):
                    self.type_args()
                elif self.op("(") and c.value in ("Fn", "FnMut", "FnOnce"):
                    self.next()
                    while not self.op(")"):
                        self.type_()
                        if not self.eat(","):
                            break
                    self.need(")")
                    if self.eat("->"):
                        self.type_()
            elif self.op("::") and self.peek().value in ("<", "<<"):
                self.next()
                self.type_args()
            if not self.eat("::"):
                return

    def type_args(self) -> None:
        self.split("<")
        while not (self.cur.kind == "op" and str(self.cur.value).startswith(">")):
            if self.cur.kind == "life":
                self.next()
            elif self.cur.kind in ("num", "str") or self.at("true", "false"):
                self.next()
            elif self.op("-"):
                self.next()
                self.next()
            elif self.op("{"):
                self.block()
            elif self.is_ident() and self.peek().value in ("=", ":") and self.peek().kind == "op":
                self.next()
                if self.eat("="):
                    self.type_()
                else:
                    self.next()
                    self.bounds()
            else:
                self.type_()
            if not self.eat(","):
                break
        if not self.split(">"):
            self.fail("type arguments not closed")

    def type_(self) -> None:
        c = self.cur
        if c.kind == "op":
            if c.value == "&" or c.value == "&&":
                self.next()
                if self.cur.kind == "life":
                    self.next()
                self.eat("mut")
                return self.type_()
            if c.value == "*":
                self.next()
                if not self.eat("const", "mut"):
                    self.fail()
                return self.type_()
            if c.value == "(":
                self.next()
                while not self.op(")"):
                    self.type_()
                    if not self.eat(","):
                        break
                self.need(")")
                return None
            if c.value == "[":
                self.next()
                self.type_()
                if self.eat(";"):
                    self.expr()
                self.need("]")
                return None
            if c.value == "!":
                self.next()
                return None
        if self.at("_"):
            self.next()
            return None
        if self.at("dyn", "impl"):
            self.next()
            return self.bounds()
        self.for_life()
        if self.at("fn", "unsafe", "extern"):
            while self.at("unsafe", "extern"):
                self.next()
                if self.cur.kind == "str":
                    self.next()
            self.need("fn")
            self.need("(")
            while not self.op(")"):
                if self.is_ident() and self.peek().value == ":":
                    self.next()
                    self.next()
                self.type_()
                if not self.eat(","):
                    break
            self.need(")")
            if self.eat("->"):
                self.type_()
            return None
        self.path(False)
        if self.op("!"):
            self.next()
            self.tree()
        return None

    def pattern(self) -> None:
        self.eat("|")
        self.pattern_one()
        while self.eat("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        c = self.cur
        if c.kind in ("num", "str") or self.op("-") or self.at("true", "false"):
            self.eat("-")
            self.next()
            if self.eat("..", "..=", "...") and (self.cur.kind in ("num", "str") or self.op("-") or self.is_ident()):
                self.eat("-")
                self.next()
        elif self.eat("_"):
            pass
        elif self.op("..", "..="):
            self.next()
            if self.cur.kind in ("num", "str"):
                self.next()
        elif self.op("&", "&&"):
            self.next()
            self.eat("mut")
            self.pattern_one()
        elif self.op("(", "["):
            close = CLOSER[self.next().value]
            while not self.op(close):
                self.pattern()
                if not self.eat(","):
                    break
            self.need(close)
        elif self.at("ref", "mut", "box"):
            self.eat("ref")
            self.eat("mut")
            self.ident()
            if self.eat("@"):
                self.pattern_one()
        else:
            self.path(True)
            if self.op("("):
                self.next()
                while not self.op(")"):
                    self.pattern()
                    if not self.eat(","):
                        break
                self.need(")")
            elif self.op("{"):
                self.next()
                while not self.op("}"):
                    self.attributes()
                    if self.eat(".."):
                        break
                    self.eat("ref")
                    self.eat("mut")
                    if self.next().kind not in ("id", "num"):
                        self.fail()
                    if self.eat(":"):
                        self.pattern()
                    if not self.eat(","):
                        break
                self.need("}")
            elif self.eat("@"):
                self.pattern_one()
            elif self.op("!"):
                self.next()
                self.tree()
            elif self.eat("..", "..=", "..."):
                if self.cur.kind in ("num", "str") or self.is_ident():
                    self.next()

    # statements and expressions
    ITEMS = frozenset("use mod fn struct enum trait impl static type extern".split())

    def block(self) -> None:
        self.need("{")
        while self.op("#") and self.peek().value == "!":
            self.attribute()
        while not self.op("}"):
            self.statement()
        self.next()

    def statement(self) -> None:
        if self.eat(";"):
            return
        self.attributes()
        c = self.cur
        v = c.value if c.kind == "id" else ""
        if v == "let":
            self.next()
            self.pattern()
            if self.eat(":"):
                self.type_()
            if self.eat("="):
                self.expr()
                if self.eat("else"):
                    self.block()
            self.need(";")
            return
        if v in self.ITEMS or v == "pub" or (v == "const" and self.peek().value != "{") or (v in ("async", "unsafe") and self.peek().value in ("fn", "impl", "trait", "extern")):
            self.item()
            return
        if v == "macro_rules":
            self.item()
            return
        blocky = self.op("{") or v in ("if", "match", "for", "while", "loop", "unsafe") or (c.kind == "life")
        if blocky:
            self.blocklike()
            if self.op(".", "?"):
                self.postfix()
                self.operators(0, True)
                self.assignment_tail()
            elif self.op("}") or not self.eat(";"):
                return
            else:
                return
        else:
            mark = self.i
            self.expr()
            made = self.t[self.i - 1]
            if self.op("}"):
                return
            if made.value == "}" and made.kind == "op" and any(self.t[k].value == "!" and self.t[k].kind == "op" for k in range(mark, min(mark + 8, self.i))) and not self.op(";"):
                return
            self.need(";")
            return
        if not self.op("}"):
            self.eat(";")

    def assignment_tail(self) -> None:
        if self.cur.kind == "op" and self.cur.value in ASSIGN:
            self.next()
            self.expr()

    def expr(self, struct: bool = True) -> None:
        c = self.cur
        if c.kind == "id" and c.value in ("return", "break", "continue"):
            self.next()
            if c.value != "return" and self.cur.kind == "life":
                self.next()
            if c.value != "continue" and not (self.op(";", "}", ")", "]", ",", "=>") or self.cur.kind == "eof"):
                self.expr(struct)
            return
        if self.op("..", "..="):
            self.next()
            if self.starts():
                self.operand(struct)
                self.operators(0, struct)
            return
        self.operand(struct)
        self.operators(0, struct)
        if self.op("..", "..="):
            self.next()
            if self.starts() and (struct or not self.op("{")):
                self.operand(struct)
                self.operators(0, struct)
        if self.cur.kind == "op" and self.cur.value in ASSIGN:
            self.next()
            self.expr(struct)

    def starts(self) -> bool:
        c = self.cur
        return c.kind in ("num", "str", "life") or (c.kind == "id" and (c.value not in KEYWORDS or c.value in PATH_WORDS or c.value in ("if", "match", "true", "false", "loop", "unsafe", "move"))) or self.op("(", "[", "{", "-", "!", "*", "&", "|", "||", "<")

    def operators(self, least: int, struct: bool) -> None:
        while True:
            if self.at("as"):
                self.next()
                self.type_()
                continue
            c = self.cur
            p = BINARY.get(c.value, 0) if c.kind == "op" else 0
            if p <= least:
                return
            self.next()
            if self.at("return", "break", "continue"):
                self.expr(struct)
                return
            self.operand(struct)
            self.operators(p, struct)

    def operand(self, struct: bool) -> None:
        while self.op("-", "!", "*", "&", "&&"):
            amp = self.op("&", "&&")
            self.next()
            if amp:
                self.eat("mut")
        if self.at("let"):
            self.next()
            self.pattern()
            self.need("=")
            self.operand(struct)
            self.operators(2, struct)
            return
        self.primary(struct)
        self.postfix()

    unary = lambda self: self.operand(True)

    def blocklike(self) -> None:
        if self.cur.kind == "life":
            self.next()
            self.need(":")
        c = self.cur
        v = c.value
        if c.kind == "op" and v == "{":
            return self.block()
        if v == "if":
            self.next()
            self.expr(False)
            self.block()
            if self.eat("else"):
                if self.at("if"):
                    self.blocklike()
                else:
                    self.block()
            return None
        if v == "match":
            self.next()
            self.expr(False)
            self.need("{")
            while not self.op("}"):
                self.attributes()
                self.pattern()
                if self.eat("if"):
                    self.expr()
                self.need("=>")
                brace = self.op("{")
                mark = self.i
                if brace:
                    self.block()
                    if self.op(".", "?"):
                        self.i = mark
                        self.expr()
                else:
                    self.expr()
                if not self.eat(",") and not (brace or self.op("}")):
                    self.fail("expected ,")
            self.next()
            return None
        if v == "for":
            self.next()
            self.pattern()
            self.need("in")
            self.expr(False)
            return self.block()
        if v == "while":
            self.next()
            self.expr(False)
            return self.block()
        if v in ("loop", "unsafe", "async", "const"):
            self.next()
            self.eat("move")
            return self.block()
        self.fail("expected block")
        return None

    def primary(self, struct: bool) -> None:
        c = self.cur
        if c.kind in ("num", "str"):
            self.next()
            return
        if c.kind == "life":
            return self.blocklike()
        if c.kind == "op":
            if c.value == "(":
                self.next()
                while not self.op(")"):
                    self.expr()
                    if not self.eat(","):
                        break
                self.need(")")
                return
            if c.value == "[":
                self.next()
                while not self.op("]"):
                    self.expr()
                    if self.eat(";"):
                        self.expr()
                        break
                    if not self.eat(","):
                        break
                self.need("]")
                return
            if c.value == "{":
                return self.block()
            if c.value in ("|", "||"):
                return self.closure()
            if c.value not in ("<", "<<", "::"):
                self.fail("expected expression")
        v = c.value
        if c.kind == "id":
            if v in ("true", "false"):
                self.next()
                return
            if v in ("if", "match", "for", "while", "loop", "unsafe") or (v in ("async", "const") and self.peek().value in ("{", "move")):
                return self.blocklike()
            if v in ("move", "async", "static"):
                self.eat("async")
                self.eat("static")
                self.eat("move")
                return self.closure()
            if v in ("return", "break", "continue"):
                return self.expr(struct)
            if v in KEYWORDS and v not in PATH_WORDS:
                self.fail("expected expression")
        elif c.kind != "op":
            self.fail("expected expression")
        self.path(True)
        if self.op("!") and self.peek().value in ("(", "[", "{"):
            self.next()
            self.tree()
        elif self.op("{") and struct and self.struct_ahead():
            self.next()
            while not self.op("}"):
                self.attributes()
                if self.eat(".."):
                    if not self.op("}"):
                        self.expr()
                    break
                if self.next().kind not in ("id", "num"):
                    self.i -= 1
                    self.fail("expected field")
                if self.eat(":"):
                    self.expr()
                if not self.eat(","):
                    break
            self.need("}")

    def struct_ahead(self) -> bool:
        a, b = self.peek(), self.peek(2)
        return a.value == "}" or a.value == ".." or a.value == "#" or (a.kind in ("id", "num") and b.kind == "op" and b.value in (":", ",", "}"))

    def closure(self) -> None:
        if not self.eat("||"):
            self.need("|")
            while not self.op("|"):
                self.attributes()
                self.pattern_one()
                if self.eat(":"):
                    self.type_()
                if not self.eat(","):
                    break
            self.need("|")
        if self.eat("->"):
            self.type_()
            self.block()
        else:
            self.expr()

    def postfix(self) -> None:
        while True:
            if self.op("?"):
                self.next()
            elif self.op("."):
                self.next()
                if self.cur.kind == "num":
                    self.next()
                elif self.eat("await"):
                    pass
                else:
                    self.ident()
                    if self.op("::"):
                        self.next()
                        self.type_args()
            elif self.op("("):
                self.next()
                while not self.op(")"):
                    self.expr()
                    if not self.eat(","):
                        break
                self.need(")")
            elif self.op("["):
                self.next()
                self.expr()
                self.need("]")
            else:
                return


def check(text: str) -> None:
    Rust(tokens(text)).file()
