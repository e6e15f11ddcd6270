"""Grammar of JavaScript modules and, with types, of TypeScript."""

from __future__ import annotations

import re

from waymark.llm.syntax.base import Bad, Cursor, Tok

ID = r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4})*"
TOKEN = re.compile(
    "[ \\t\\f\\v\xa0\ufeff]*+(?:(?P<tok>"
    r"[A-Za-z_$][\w$]*+(?![\\\u200c\u200d])"
    r"|[,;:~@]|\.(?![\d.])|=(?![=>])"
    r"|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*+\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'"
    r"|(?=\.?\d)(?:0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?)n?(?![\w$])"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[<+>\-*%&|^!?]"
    rf"|\#?{ID})"
    r"|(?P<open>[{(\[])|(?P<close>[})\]])"
    r"|(?P<nl>\r\n|[\n\r\u2028\u2029])"
    r"|(?P<lc>//[^\n\r\u2028\u2029]*)|(?P<bc>/\*[\s\S]*?\*/)"
    r"|(?P<slash>/=?)|(?P<tpl>`)|(?P<end>\Z))"
)
PLAIN = re.compile(r"(?:\s*+(?:-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|\"[^\"\\\n\r]*+\"|'[^'\\\n\r]*+')\s*+,)++")
"""Plain elements of a list, each with its comma."""
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:(?P<end>`)|(?P<hole>\$\{))")
REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public await".split())
HARD = RESERVED - frozenset("let static implements interface package private protected public await yield".split())
EXPR_WORDS = frozenset("return typeof instanceof in of new delete void throw case do else yield await default".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


WORDS = RESERVED | frozenset(
    "async of from as get set accessor target meta type satisfies namespace module declare global abstract readonly override"
    " keyof unique infer asserts is out undefined assert".split()
)
"""Words the grammar asks for; any other name is as good as the next."""
NEAR = 256
"""Tokens of a statement whose shape is remembered."""
SHAPES: dict[tuple, bool] = {}


class Sign(Tok):
    """A token as the grammar sees it; the same one stands for every place where it occurs."""

    __slots__ = ("shape",)

    def __init__(self, v: str, nl: bool) -> None:
        c = v[0]
        if c in "\"'":
            kind, shape = "str", "s "
        elif c.isdigit() or (c == "." and v[1:2].isdigit()):
            kind, shape = "num", "n "
        elif c in "(){}[],;:~@":
            kind, shape = "op", v
        elif c.isalpha() or c in "_$\\#":
            kind, shape = "id", v + " " if v in WORDS else "# " if c == "#" else "a "
        else:
            kind, shape = "op", v + " "
        super().__init__(kind, v, 0, nl)
        self.shape = "\n" + shape if nl else shape


SIGNS: tuple[dict[str, Sign], dict[str, Sign]] = ({}, {})
"""Known tokens, within a line and behind a line's end."""


def sign(v: str, nl: bool) -> Sign:
    known = SIGNS[nl]
    if len(known) > 1 << 16:
        known.clear()
    got = known[v] = Sign(v, nl)
    return got


def special(kind: str, value: object, shape: str, nl: bool) -> Sign:
    got = Sign(";", nl)
    got.kind, got.value, got.shape = kind, value, "\n" + shape if nl else shape
    return got


class Run(list):
    """Tokens, the places of their ends in the text and the place of each bracket's match."""

    def __init__(self, text: str) -> None:
        super().__init__()
        self.text = text
        self.at: list[int] = []
        self.close: dict[int, int] = {}


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def tokens(text: str, at: int = 0, inner: bool = False) -> tuple[Run, int]:
    """Tokens up to the end, or up to the } that closes a template's expression."""
    out = Run(text)
    ends, close, stack = out.at, out.close, []
    if at == 0 and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else len(text)
    match = TOKEN.scanner(text, at).match
    nl, known = False, SIGNS[0]
    while True:
        m = match()
        if m is None:
            while at < len(text) and text[at] in " \t\f\v\xa0\ufeff":
                at += 1
            raise Bad(line_of(text, at), f"illegal character {text[at : at + 1]!r}")
        kind, at = m.lastgroup, m.end()
        if kind == "tok":
            v = m[1]
            tok = known.get(v) or sign(v, nl)
        elif kind == "nl":
            nl, known = True, SIGNS[1]
            continue
        elif kind == "open":
            v = m[2]
            tok = known.get(v) or sign(v, nl)
            if v == "[" and out:
                p = out[-1]
                if (p.kind == "op" and p.value not in (")", "]", "}", ".", "?.", "!")) or (p.kind == "id" and p.value == "return"):
                    r = PLAIN.match(text, at)  # [1, 2, x] is a list where [x] is one
                    if r:
                        match = TOKEN.scanner(text, r.end()).match
            stack.append(len(out))
        elif kind == "close":
            v = m[3]
            tok = known.get(v) or sign(v, nl)
            if stack:
                close[stack.pop()] = len(out)
            elif inner and v == "}":
                break
        elif kind in ("lc", "bc"):
            if kind == "bc" and "\n" in m["bc"]:
                nl, known = True, SIGNS[1]
            continue
        elif kind == "end":
            if inner:
                raise Bad(line_of(text, at), "unterminated template expression")
            break
        elif kind == "slash":
            p = out[-1] if out else None
            v = m["slash"]
            if p is None or (p.kind == "op" and p.value not in (")", "]", "}")) or (p.kind == "id" and p.value in EXPR_WORDS):
                r = REGEX.match(text, at - len(v))
                if r is None:
                    raise Bad(line_of(text, at), "unterminated regular expression")
                tok, at = special("re", r.group(), "r ", nl), r.end()
                match = TOKEN.scanner(text, at).match
            else:
                tok = known.get(v) or sign(v, nl)
        else:
            subs, held, first = [], ["`"], at
            while True:
                t = TEMPLATE.match(text, at)
                if t is None:
                    raise Bad(line_of(text, first), "unterminated template")
                at = t.end()
                if t.lastgroup == "end":
                    break
                sub, at = tokens(text, at, True)
                subs.append(sub)
                held += [x.shape for x in sub]
            tok = special("tpl", subs, "".join(held) + "`", nl)
            match = TOKEN.scanner(text, at).match
        out.append(tok)
        ends.append(at)
        nl, known = False, SIGNS[0]
    out.append(special("eof", "", "$", nl))
    ends.append(at)
    return out, at


class Ecma(Cursor):
    def __init__(self, toks: Run, ts: bool, in_fn: int = 0, loops: int = 0) -> None:
        super().__init__(toks)
        self.close = toks.close
        self.ts, self.fn, self.loop, self.no_in = ts, in_fn, loops, False
        self.undo: list[tuple[int, Tok]] = []

    def fail(self, why: str = "unexpected") -> None:
        raise Bad(line_of(self.t.text, self.t.at[self.i]), f"{why}: {str(self.cur.value)[:30]!r}")

    def split(self, value: str) -> bool:
        c = self.cur
        if c.kind != "op" or not c.value.startswith(value):
            return False
        if c.value == value:
            self.i += 1
        else:
            self.undo.append((self.i, c))
            self.t[self.i] = sign(c.value[len(value) :], False)
        return True

    def back(self, at: int, done: int) -> None:
        """Return to a place, with the signs that were split since."""
        while len(self.undo) > done:
            k, tok = self.undo.pop()
            self.t[k] = tok
        self.i = at

    # statements
    def module(self) -> None:
        while self.cur.kind != "eof":
            self.remembered(True)

    def ends(self) -> tuple[int, int]:
        """Where a short statement may end: behind the first } and behind the first ; at its own depth, or 0."""
        k, brace, toks, close = self.i, 0, self.t, self.close
        limit = k + NEAR
        while k < limit:
            tok = toks[k]
            if tok.kind == "op":
                v = tok.value
                if v == ";":
                    return brace, k + 1
                if v in ("(", "[", "{"):
                    k = close.get(k, limit)
                    if v == "{" and not brace and k < limit:
                        brace = k + 1
                elif v in (")", "]", "}"):
                    break
            elif tok.kind == "eof":
                break
            k += 1
        return brace, 0

    def remembered(self, top: bool = False) -> None:
        """A statement, read anew only if no statement of its shape, next token included, was read before."""
        at = self.i
        keys = []
        for end in self.ends():
            if end:
                key = (self.ts, top, self.fn > 0, self.loop > 0, self.no_in, "".join([c.shape for c in self.t[at : end + 1]]))
                if key in SHAPES:
                    self.i = end
                    return
                keys.append((end, key))
        self.statement(top)
        for end, key in keys:
            if end == self.i:
                if len(SHAPES) > 1 << 16:
                    SHAPES.clear()
                SHAPES[key] = True

    def end(self) -> None:
        if self.eat(";") or self.op("}") or self.cur.kind == "eof" or self.cur.nl:
            return
        self.fail("statement not ended")

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            if self.cur.kind == "eof":
                self.fail("block not closed")
            self.remembered()
        self.next()

    def body(self) -> None:
        loop, self.loop = self.loop, 0
        self.fn += 1
        no_in, self.no_in = self.no_in, False
        self.block()
        self.no_in = no_in
        self.fn -= 1
        self.loop = loop

    def looped(self) -> None:
        self.loop += 1
        self.statement()
        self.loop -= 1

    def statement(self, top: bool = False) -> None:
        c = self.cur
        if c.kind == "op":
            if c.value == "{":
                return self.block()
            if c.value == ";":
                self.next()
                return None
            if c.value == "@":
                self.decorators()
                return self.statement(top)
        elif c.kind == "id":
            v = c.value
            if v in ("import", "export"):
                if v == "import" and self.peek().value in ("(", "."):
                    self.expression()
                    return self.end()
                if not top:
                    self.fail("only at top level")
                return self.import_() if v == "import" else self.export_()
            if v in ("var", "const") or (v == "let" and (self.peek().kind == "id" or self.peek().value in ("[", "{"))):
                if self.ts and v == "const" and self.peek().value == "enum":
                    self.next()
                    return self.enum_()
                self.variables()
                return self.end()
            if v == "function" or (v == "async" and self.peek().value == "function" and not self.peek().nl):
                return self.function(True)
            if v == "class":
                return self.class_(True)
            if v == "if":
                self.next()
                self.paren()
                self.statement()
                if self.eat("else"):
                    self.statement()
                return None
            if v == "for":
                return self.for_()
            if v == "while":
                self.next()
                self.paren()
                return self.looped()
            if v == "do":
                self.next()
                self.looped()
                self.need("while")
                self.paren()
                self.eat(";")
                return None
            if v == "return":
                if not self.fn:
                    self.fail("return outside function")
                self.next()
                if not (self.op(";", "}") or self.cur.kind == "eof" or self.cur.nl):
                    self.expression()
                return self.end()
            if v in ("break", "continue"):
                self.next()
                if self.cur.kind == "id" and not self.cur.nl and self.cur.value not in HARD:
                    self.next()
                elif not self.loop:
                    self.fail(f"{v} outside loop")
                return self.end()
            if v == "throw":
                self.next()
                if self.cur.nl:
                    self.fail("line break after throw")
                self.expression()
                return self.end()
            if v == "try":
                self.next()
                self.block()
                some = False
                if self.eat("catch"):
                    some = True
                    if self.eat("("):
                        self.pattern()
                        if self.ts and self.eat(":"):
                            self.type_()
                        self.need(")")
                    self.block()
                if self.eat("finally"):
                    some = True
                    self.block()
                if not some:
                    self.fail("try without catch")
                return None
            if v == "switch":
                self.next()
                self.paren()
                self.need("{")
                self.loop += 1
                while not self.eat("}"):
                    if self.eat("case"):
                        self.expression()
                    elif not self.eat("default"):
                        self.fail("expected case")
                    self.need(":")
                    while not self.at("case", "default", "}"):
                        self.remembered()
                self.loop -= 1
                return None
            if v == "debugger":
                self.next()
                return self.end()
            if self.ts and self.ts_statement(v):
                return None
            if self.peek().value == ":" and self.peek().kind == "op" and v not in HARD:
                self.next()
                self.next()
                return self.statement()
        self.expression()
        return self.end()

    def ts_statement(self, v: str) -> bool:
        p = self.peek()
        if p.nl:
            return False
        if v == "interface" and p.kind == "id":
            self.next()
            self.name()
            self.generics()
            while self.eat("extends", ","):
                self.type_()
            self.object_type()
            return True
        if v == "type" and p.kind == "id" and self.peek(2).value in ("=", "<"):
            self.next()
            self.name()
            self.generics()
            self.need("=")
            self.type_()
            self.end()
            return True
        if v == "enum" and p.kind == "id":
            self.enum_()
            return True
        if v in ("namespace", "module") and p.kind in ("id", "str"):
            self.next()
            self.next()
            while self.eat("."):
                self.name()
            self.need("{")
            while not self.eat("}"):
                self.statement(top=True)
            return True
        if v == "declare" and p.kind == "id":
            self.next()
            if self.at("function"):
                self.next()
                self.name()
                self.generics()
                self.params()
                if self.eat(":"):
                    self.type_()
                self.end()
            elif self.at("global"):
                self.next()
                self.block()
            else:
                self.statement(top=True)
            return True
        if v == "abstract" and p.value == "class":
            self.next()
            self.class_(True)
            return True
        return False

    def enum_(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.eat("}"):
            if self.next().kind not in ("id", "str"):
                self.fail()
            if self.eat("="):
                self.assignment()
            if not self.eat(","):
                self.need("}")
                break

    def decorators(self) -> None:
        while self.eat("@"):
            self.unary()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def variables(self) -> None:
        kind = self.next().value
        while True:
            plain = self.cur.kind == "id"
            self.pattern()
            if self.ts:
                self.eat("!")
                if self.eat(":"):
                    self.type_()
            if self.eat("="):
                self.assignment()
            elif (kind == "const" or not plain) and not (self.no_in and self.at("of", "in")) and not self.ts:
                self.fail("missing initializer")
            if not self.eat(","):
                return

    def for_(self) -> None:
        self.need("for")
        self.eat("await")
        self.need("(")
        self.no_in = True
        if not self.op(";"):
            if self.at("var", "const") or (self.at("let") and (self.peek().kind == "id" or self.peek().value in ("[", "{"))):
                self.variables()
            else:
                self.expression()
        self.no_in = False
        if self.eat("of", "in"):
            self.expression()
        else:
            self.need(";")
            if not self.op(";"):
                self.expression()
            self.need(";")
            if not self.op(")"):
                self.expression()
        self.need(")")
        self.looped()

    def import_(self) -> None:
        self.need("import")
        if self.cur.kind == "str":
            self.next()
            self.attributes()
            return self.end()
        if self.ts and self.at("type") and self.peek().value not in ("from", ","):
            self.next()
        if self.cur.kind == "id":
            self.name()
            if self.ts and self.eat("="):
                self.expression()
                return self.end()
            if self.eat(",") and not self.op("{", "*"):
                self.fail()
        if self.eat("*"):
            self.need("as")
            self.name()
        elif self.op("{"):
            self.specifiers()
        self.need("from")
        if self.next().kind != "str":
            self.i -= 1
            self.fail("expected module name")
        self.attributes()
        return self.end()

    def attributes(self) -> None:
        if self.at("with", "assert") and not self.cur.nl:
            self.next()
            self.object_()

    def specifiers(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.ts and self.at("type") and self.peek().value not in (",", "}", "as"):
                self.next()
            if self.next().kind not in ("id", "str"):
                self.i -= 1
                self.fail()
            if self.eat("as") and self.next().kind not in ("id", "str"):
                self.fail()
            if not self.eat(","):
                self.need("}")
                break

    def export_(self) -> None:
        self.need("export")
        if self.eat("default"):
            if self.at("function") or (self.at("async") and self.peek().value == "function"):
                return self.function(False)
            if self.at("class") or (self.ts and self.at("abstract")):
                self.eat("abstract")
                return self.class_(False)
            if self.ts and self.at("interface"):
                return self.statement(True)
            self.assignment()
            return self.end()
        if self.ts and self.at("type") and self.peek().value in ("{", "*"):
            self.next()
        if self.eat("*"):
            if self.eat("as") and self.next().kind not in ("id", "str"):
                self.fail()
            self.need("from")
            if self.next().kind != "str":
                self.fail()
            return self.end()
        if self.op("{"):
            self.specifiers()
            if self.eat("from") and self.next().kind != "str":
                self.fail()
            return self.end()
        if self.ts and self.eat("="):
            self.expression()
            return self.end()
        if self.at("var", "let", "const", "function", "class", "async", "@") or (self.ts and self.at("interface", "type", "enum", "namespace", "module", "declare", "abstract", "import")):
            return self.statement(True)
        self.fail("nothing to export")
        return None

    # functions and classes
    def function(self, named: bool) -> None:
        self.eat("async")
        self.need("function")
        self.eat("*")
        if self.cur.kind == "id" and not self.op("("):
            self.name()
        elif named:
            self.fail("expected name")
        self.generics()
        self.params()
        if self.ts and self.eat(":"):
            self.return_type()
        if self.ts and not self.op("{"):
            return self.end()
        return self.body()

    def params(self) -> None:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        while not self.op(")"):
            self.param()
            if not self.eat(","):
                break
        self.need(")")
        self.no_in = no_in

    def param(self) -> None:
        self.decorators()
        if self.ts:
            while self.at("public", "private", "protected", "readonly", "override") and self.peek().kind == "id":
                self.next()
        if self.eat("..."):
            pass
        if self.ts and self.at("this"):
            self.next()
        else:
            self.pattern()
        if self.ts:
            self.eat("?")
            if self.eat(":"):
                self.type_()
        if self.eat("="):
            self.assignment()

    def pattern(self) -> None:
        if self.eat("["):
            while not self.op("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.pattern()
                if self.eat("="):
                    self.assignment()
                if not self.eat(","):
                    break
            self.need("]")
        elif self.eat("{"):
            while not self.op("}"):
                if self.eat("..."):
                    self.pattern()
                else:
                    short = self.cur.kind == "id"
                    self.key()
                    if self.eat(":"):
                        self.pattern()
                    elif not short:
                        self.fail()
                    if self.eat("="):
                        self.assignment()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.name()

    def name(self) -> None:
        c = self.cur
        if c.kind != "id" or c.value in HARD or c.value[0] == "#":
            self.fail("expected name")
        self.i += 1

    def key(self) -> None:
        if self.eat("["):
            self.assignment()
            self.need("]")
        elif self.cur.kind in ("id", "str", "num"):
            self.next()
        else:
            self.fail("expected key")

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.cur.kind == "id" and not self.at("extends", "implements"):
            self.name()
        elif named:
            self.fail("expected name")
        self.generics()
        if self.eat("extends"):
            self.postfix(self.primary())
            if self.ts and self.op("<"):
                self.type_args()
        if self.ts and self.eat("implements"):
            self.type_()
            while self.eat(","):
                self.type_()
        self.need("{")
        while not self.eat("}"):
            if not self.eat(";"):
                self.member()

    def member(self) -> None:
        self.decorators()
        words = ("static", "async", "get", "set", "accessor") + (("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.ts else ())
        while self.at(*words) and self.peek().value not in ("(", "=", ";", "}", ":", "?", "!", "<", ",") and not (self.peek().nl and self.at("get", "set", "accessor")):
            self.next()
            if self.op("{"):
                return self.body()
        self.eat("*")
        if self.ts and self.op("[") and self.peek().kind == "id" and self.peek(2).value == ":":
            self.next()
            self.name()
            self.next()
            self.type_()
            self.need("]")
        else:
            self.key()
        if self.ts:
            self.eat("?", "!")
        if self.op("(") or (self.ts and self.op("<")):
            self.generics()
            self.params()
            if self.ts and self.eat(":"):
                self.return_type()
            if self.ts and not self.op("{"):
                return self.end()
            return self.body()
        if self.ts and self.eat(":"):
            self.type_()
        if self.eat("="):
            self.fn += 1
            self.assignment()
            self.fn -= 1
        return self.end()

    # expressions
    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def arrow_ahead(self) -> bool:
        """At ( or <: does the matching bracket lead to an arrow?"""
        k = self.i
        if self.t[k].value == "<":
            while not (self.t[k].kind == "op" and self.t[k].value == "("):
                if self.t[k].kind not in ("id", "op") or self.t[k].value in (";", "{", ")"):
                    return False
                k += 1
        if k not in self.close:
            return False
        k = self.close[k] + 1
        after = self.t[k]
        if after.value == "=>" and after.kind == "op":
            return True
        if self.ts and after.kind == "op" and after.value == ":":
            mark, done = self.i, len(self.undo)
            self.i = k + 1
            try:
                self.return_type()
                return self.op("=>")
            except Bad:
                return False
            finally:
                self.back(mark, done)
        return False

    def arrow_body(self) -> None:
        self.need("=>")
        if self.op("{"):
            self.body()
        else:
            self.fn += 1
            self.assignment()
            self.fn -= 1

    def assignment(self) -> None:
        c = self.cur
        if c.kind == "id":
            p = self.peek()
            if p.kind == "op" and p.value == "=>" and c.value not in HARD:
                self.next()
                return self.arrow_body()
            if c.value == "async" and not p.nl:
                if p.kind == "id" and self.peek(2).value == "=>":
                    self.next()
                    self.name()
                    return self.arrow_body()
                if p.value == "(":
                    self.next()
                    if self.arrow_ahead():
                        return self.arrow()
                    self.i -= 1
            if c.value == "yield" and self.fn:
                self.next()
                self.eat("*")
                if not (self.op(")", "]", "}", ",", ";", ":") or self.cur.nl or self.cur.kind == "eof"):
                    self.assignment()
                return None
        elif c.kind == "op" and (c.value == "(" or (self.ts and c.value == "<")) and self.arrow_ahead():
            return self.arrow()
        target = self.conditional()
        if self.cur.kind == "op" and self.cur.value in ASSIGN:
            if not target:
                self.fail("cannot assign")
            self.next()
            self.assignment()
        return None

    def arrow(self) -> None:
        self.generics()
        self.params()
        if self.ts and self.eat(":"):
            self.return_type()
        self.arrow_body()

    def conditional(self) -> bool:
        target = self.binary(0)
        if self.op("?"):
            self.next()
            no_in, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = no_in
            self.need(":")
            self.assignment()
            return False
        return target

    def binary(self, least: int) -> bool:
        target = self.unary()
        while True:
            c = self.cur
            if self.ts and c.kind == "id" and c.value in ("as", "satisfies") and not c.nl:
                self.next()
                if not self.eat("const"):
                    self.type_()
                continue
            p = BINARY.get(c.value) if c.kind in ("op", "id") else None
            if p is None or p <= least or (c.value == "in" and self.no_in):
                return target
            self.next()
            self.binary(p - 1 if c.value == "**" else p)
            target = False

    def unary(self) -> bool:
        c = self.cur
        if (c.kind == "op" and c.value in ("+", "-", "!", "~")) or (c.kind == "id" and c.value in ("typeof", "void", "delete", "await")):
            if c.value == "await" and self.peek().value in (")", ",", ";", "=", "."):
                return self.postfix(self.primary())
            self.next()
            self.unary()
            return False
        if c.kind == "op" and c.value in ("++", "--"):
            self.next()
            if not self.unary():
                self.fail("cannot change")
            return False
        if self.ts and c.kind == "op" and c.value == "<":
            self.next()
            self.type_()
            if not self.split(">"):
                self.fail()
            self.unary()
            return False
        target = self.postfix(self.primary())
        if self.op("++", "--") and not self.cur.nl:
            if not target:
                self.fail("cannot change")
            self.next()
            return False
        return target

    def args(self) -> None:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        while not self.op(")"):
            self.eat("...")
            self.assignment()
            if not self.eat(","):
                break
        self.need(")")
        self.no_in = no_in

    def postfix(self, target: bool, calls: bool = True) -> bool:
        while True:
            c = self.cur
            if c.kind == "tpl":
                self.template()
                target = False
            elif c.kind != "op":
                return target
            elif c.value in (".", "?."):
                self.next()
                target = c.value == "."
                if c.value == "?." and self.op("("):
                    self.args()
                elif c.value == "?." and self.eat("["):
                    self.expression()
                    self.need("]")
                elif self.next().kind != "id":
                    self.i -= 1
                    self.fail("expected name")
            elif c.value == "[":
                self.next()
                no_in, self.no_in = self.no_in, False
                self.expression()
                self.no_in = no_in
                self.need("]")
                target = True
            elif c.value == "(" and calls:
                self.args()
                target = False
            elif self.ts and c.value == "!" and not c.nl and self.peek().value != "=":
                self.next()
            elif self.ts and c.value in ("<", "<<") and self.call_types():
                pass
            else:
                return target

    def call_types(self) -> bool:
        mark, done = self.i, len(self.undo)
        try:
            self.type_args()
            if self.op("(") or self.cur.kind == "tpl":
                return True
        except Bad:
            pass
        self.back(mark, done)
        return False

    def template(self) -> None:
        for sub in self.next().value:
            inner = Ecma(sub, self.ts, self.fn, self.loop)
            inner.expression()
            if inner.cur.kind != "eof":
                inner.fail()

    def primary(self) -> bool:
        c = self.cur
        if c.kind in ("num", "str", "re"):
            self.next()
            return False
        if c.kind == "tpl":
            self.template()
            return False
        if c.kind == "id":
            v = c.value
            if v == "function" or (v == "async" and self.peek().value == "function" and not self.peek().nl):
                self.function(False)
                return False
            if v == "class":
                self.class_(False)
                return False
            if v == "new":
                self.next()
                if self.eat("."):
                    self.need("target")
                    return False
                self.postfix(self.primary(), calls=False)
                if self.ts and self.op("<"):
                    self.type_args()
                if self.op("("):
                    self.args()
                return False
            if v == "import":
                self.next()
                if self.eat("."):
                    self.need("meta")
                elif not self.op("("):
                    self.fail()
                return False
            if v in ("this", "null", "true", "false", "super"):
                self.next()
                return False
            if v[0] == "#":
                self.next()
                if not self.at("in"):
                    self.fail()
                return False
            self.name()
            return True
        if c.kind == "op":
            if c.value == "(":
                self.next()
                no_in, self.no_in = self.no_in, False
                self.expression()
                self.no_in = no_in
                self.need(")")
                return True
            if c.value == "[":
                self.next()
                no_in, self.no_in = self.no_in, False
                while not self.op("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assignment()
                    if not self.op("]"):
                        self.need(",")
                self.need("]")
                self.no_in = no_in
                return True
            if c.value == "{":
                self.object_()
                return True
            if c.value == "@":
                self.decorators()
                self.class_(False)
                return False
        self.fail("expected expression")
        return False

    def object_(self) -> None:
        self.need("{")
        no_in, self.no_in = self.no_in, False
        while not self.op("}"):
            if self.eat("..."):
                self.assignment()
            else:
                while self.at("async", "get", "set") and self.peek().value not in ("(", ",", ":", "}", "=", "<"):
                    self.next()
                star = self.eat("*")
                short = self.cur.kind == "id"
                word = self.cur.value
                self.key()
                if self.op("(") or (self.ts and self.op("<")):
                    self.generics()
                    self.params()
                    if self.ts and self.eat(":"):
                        self.return_type()
                    self.body()
                elif self.eat(":") and not star:
                    self.assignment()
                elif not short or word in HARD or star:
                    self.fail()
                elif self.eat("="):
                    self.assignment()
            if not self.eat(","):
                break
        self.need("}")
        self.no_in = no_in

    # types
    def generics(self) -> None:
        if self.ts and self.op("<"):
            self.next()
            while not self.op(">"):
                while self.at("const", "in", "out") and self.peek().kind == "id":
                    self.next()
                self.name()
                if self.eat("extends"):
                    self.type_()
                if self.eat("="):
                    self.type_()
                if not self.eat(","):
                    break
            if not self.split(">"):
                self.fail()

    def type_args(self) -> None:
        self.split("<")
        while True:
            self.type_()
            if not self.eat(","):
                break
        if not self.split(">"):
            self.fail("type arguments not closed")

    def return_type(self) -> None:
        if self.at("asserts") and self.peek().kind == "id" and not self.peek().nl:
            self.next()
        if self.cur.kind == "id" and self.peek().value == "is" and not self.peek().nl:
            self.next()
            self.next()
        self.type_()

    def type_(self) -> None:
        self.eat("|", "&")
        self.type_operand()
        while self.eat("|", "&"):
            self.type_operand()
        if self.at("extends") and not self.cur.nl:
            self.next()
            self.type_()
            if self.eat("?"):
                self.type_()
                self.need(":")
                self.type_()

    def type_operand(self) -> None:
        while self.at("keyof", "unique", "readonly", "infer") and (self.peek().kind in ("id", "str") or self.peek().value in ("[", "(", "{")):
            self.next()
        c = self.cur
        if self.at("new", "abstract") and self.peek().value in ("(", "<", "new"):
            self.eat("abstract")
            self.eat("new")
            c = self.cur
        if c.kind == "op" and c.value in ("(", "<") and self.arrow_ahead_type():
            self.generics()
            self.params()
            self.need("=>")
            return self.return_type()
        if c.kind in ("str", "num"):
            self.next()
        elif c.kind == "tpl":
            self.next()
        elif c.kind == "op" and c.value == "-":
            self.next()
            if self.next().kind != "num":
                self.fail()
        elif self.eat("("):
            self.type_()
            self.need(")")
        elif self.eat("["):
            while not self.op("]"):
                self.eat("...")
                if self.cur.kind == "id" and (self.peek().value == ":" or (self.peek().value == "?" and self.peek(2).value == ":")):
                    self.next()
                    self.eat("?")
                    self.next()
                self.type_()
                self.eat("?")
                if not self.eat(","):
                    break
            self.need("]")
        elif c.kind == "op" and c.value == "{":
            self.object_type()
        elif c.kind == "id":
            if c.value == "typeof":
                self.next()
            if self.at("import"):
                self.next()
                self.args()
            elif self.cur.kind == "id" and self.cur.value not in HARD - {"void", "null", "this", "true", "false", "undefined"}:
                self.next()
            else:
                self.fail("expected type")
            while self.eat("."):
                if self.next().kind != "id":
                    self.fail()
            if self.op("<", "<<") and not self.cur.nl:
                self.type_args()
        else:
            self.fail("expected type")
        while self.op("[") and not self.cur.nl:
            self.next()
            if not self.op("]"):
                self.type_()
            self.need("]")
        return None

    def arrow_ahead_type(self) -> bool:
        k = self.i
        while self.t[k].kind != "eof":
            tok = self.t[k]
            if tok.kind == "op":
                if tok.value in ("(", "[", "{"):
                    k = self.close.get(k, len(self.t) - 1)
                    if self.t[k].value == ")":
                        return self.t[k + 1].value == "=>"
                    if self.t[k].kind == "eof":
                        return False
                elif tok.value in (")", "]", "}"):
                    return False
            k += 1
        return False

    def object_type(self) -> None:
        self.need("{")
        while not self.op("}"):
            while self.at("readonly", "get", "set", "static") and self.peek().value not in (":", "?", "(", ";", ",", "}"):
                self.next()
            if self.op("+", "-"):
                self.next()
                self.need("readonly")
            if self.op("("):
                self.params()
                if self.eat(":"):
                    self.return_type()
            elif self.op("<"):
                self.generics()
                self.params()
                if self.eat(":"):
                    self.return_type()
            else:
                if self.at("new") and self.peek().value in ("(", "<"):
                    self.next()
                elif self.eat("["):
                    if self.cur.kind == "id" and self.peek().value == ":":
                        self.next()
                        self.next()
                        self.type_()
                    elif self.cur.kind == "id" and self.peek().value == "in":
                        self.next()
                        self.next()
                        self.type_()
                        if self.eat("as"):
                            self.type_()
                    else:
                        self.assignment()
                    self.need("]")
                else:
                    self.key()
                self.eat("+", "-")
                self.eat("?")
                if self.op("(", "<"):
                    self.generics()
                    self.params()
                if self.eat(":"):
                    self.return_type()
            if not (self.eat(";", ",") or self.op("}") or self.cur.nl):
                self.fail("member not ended")
        self.next()


def check(text: str, ts: bool) -> None:
    """Raise Bad if the text is no module."""
    toks, _ = tokens(text)
    Ecma(toks, ts).module()
