"""Outlines of source texts in eighteen languages: definitions, calls and exports, read from tokens.

A text is cut into tokens by its language's lexical rules, so nothing inside comments, strings or regular
expressions is ever a name, and brackets are paired once. A small grammar per language then walks declarations:
type bodies are read member by member, other brackets only for nested declarations and calls. Unreadable
stretches are skipped, never guessed from single lines. Rows are (position, kind, name, is a reference); the kinds
are those of the capture names, normalised by ``CAPTURE_KINDS``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

CAPTURE_KINDS = {"field": "variable", "macro": "function", "namespace": "module", "constructor": "method", "object": "module", "property": "variable"}
REFERENCE_KINDS = {"type": "type_reference", "module": "module_dependency"}
REFERENCE_TARGETS = {"call": "callable", "export": "export", "import": "module", "module": "module", "type": "type"}
"""Kinds of definitions and references by capture, and what a reference points at (fixed values)."""

Row = tuple[int, str, str, bool]

DQ, SQ = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"?", r"'(?:[^'\\\n]|\\[\s\S])*+'?"
TRIPLE = r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)"
LINE, BLOCK, NESTED = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)", r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*(?:\*/|\Z)"
CHAR = r"'(?:[^'\\\n]|\\[^\n]+?)'"
OPS = r"=>|->|::|\?\.|\.\.\.|<<=|>>=|[-+*/%&|^!=<>:?]=|&&|\|\||\S"


def rules(skip: list[str], strings: list[str], ident: str = r"[^\W\d]\w*", pre: str | None = None) -> re.Pattern:
    parts = [f"(?P<skip>{'|'.join(skip)})", *([f"(?P<pre>{pre})"] if pre else []), f"(?P<str>{'|'.join(strings)})", f"(?P<id>{ident})", r"(?P<num>\d[\w.]*)", f"(?P<op>{OPS})"]
    return re.compile("|".join(parts), re.MULTILINE)


C_PRE = r"^[ \t]*#[ \t]*\w+(?:[^\n\\/]|\\[\s\S]|/(?![*/]))*"
LEX = {
    "rs": rules([LINE, NESTED], [r"\b[bc]?r(?P<h>#*)\"[\s\S]*?\"(?P=h)", r"[bc]?\"(?:[^\"\\]|\\[\s\S])*+\"?", r"b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'", r"'[^\W\d]\w*"], r"(?:r#)?[^\W\d]\w*"),
    "js": rules([LINE, BLOCK], [DQ, SQ, r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\}|`[^`]*`)*\})*`?"], r"#?[^\W\d$][\w$]*|\$[\w$]*"),
    "java": rules([LINE, BLOCK], [TRIPLE, DQ, CHAR], r"[^\W\d][\w$]*"),
    "cs": rules([LINE, BLOCK], [r"\$*\"\"\"[\s\S]*?\"\"\"", r"(?:@\$?|\$@)\"(?:[^\"]|\"\")*\"?", r"\$?" + DQ, CHAR], r"@?[^\W\d]\w*", r"^[ \t]*#[^\n]*"),
    "go": rules([LINE, BLOCK], [DQ, r"`[^`]*`?", CHAR]),
    "c": rules([LINE, BLOCK], [r"(?:u8|[uUL])?R\"(?P<d>[^()\\\s]*)\([\s\S]*?\)(?P=d)\"", DQ, CHAR], pre=C_PRE),
    "php": rules([LINE, r"#(?!\[)[^\n]*", BLOCK, r"\?>[\s\S]*?(?:<\?php|<\?=|\Z)"], [r"<<<\s*['\"]?(?P<t>\w+)['\"]?\n[\s\S]*?\n\s*(?P=t)\b", r"\"(?:[^\"\\]|\\[\s\S])*+\"?", r"'(?:[^'\\]|\\[\s\S])*+'?"], r"\$?[^\W\d]\w*"),
    "kt": rules([LINE, NESTED], [TRIPLE, DQ, CHAR], r"[^\W\d]\w*|`[^`\n]+`"),
    "scala": rules([LINE, NESTED], [r"\w*" + TRIPLE, DQ, r"'(?:[^'\\\n]|\\[^\n]+?)'"], r"[^\W\d]\w*|`[^`\n]+`"),
    "swift": rules([LINE, NESTED], [r"(?P<s>#+)\"[\s\S]*?\"(?P=s)", TRIPLE, DQ], r"[^\W\d]\w*|`[^`\n]+`"),
    "dart": rules([LINE, NESTED], [r"r?(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')", r"r\"[^\"\n]*\"?|r'[^'\n]*'?", DQ, SQ], r"[^\W\d][\w$]*|\$[\w$]*"),
    "rb": rules([r"#[^\n]*", r"^=begin[\s\S]*?(?:^=end|\Z)", r"^__END__[\s\S]*"], [r"<<[~-]?(['\"]?)(?P<t>[A-Z_]+)\1[^\n]*\n[\s\S]*?\n\s*(?P=t)$", r"\"(?:[^\"\\]|\\[\s\S])*+\"?", r"'(?:[^'\\]|\\[\s\S])*+'?", r"%[qQwWiI]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})"], r"[^\W\d]\w*[?!]?(?![=\w])|[^\W\d]\w*"),
    "sh": rules([r"(?<![^\s;(])#[^\n]*"], [r"<<-?\s*['\"]?(?P<t>\w+)['\"]?[^\n]*\n[\s\S]*?\n\s*(?P=t)$", r"\"(?:[^\"\\]|\\[\s\S])*+\"?", r"'[^']*'?", r"\\[\s\S]", r"\$\{[^}]*\}|\$\w+"], r"[^\W\d][\w-]*"),
    "nix": rules([r"#[^\n]*", BLOCK], [r"''[\s\S]*?''(?![$'\\])", r"\"(?:[^\"\\]|\\[\s\S])*+\"?"], r"[^\W\d][\w'-]*"),
}
LANGUAGES = {e: e for e in "rs py js jsx ts tsx java go c cs cpp sh rb php scala kt swift dart nix".split()} | {"h": "c", "cc": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "bash": "sh", "kts": "kt", "mjs": "js", "cjs": "js"}
"""Language id by extension (fixed values)."""
FAMILY = {"jsx": "js", "ts": "js", "tsx": "js", "cpp": "c"}
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
BEFORE_VALUE = frozenset("return typeof case in of do else void delete throw new instanceof await yield".split())
NO_CALL = frozenset("if for while switch catch return function new else do try super import await typeof sizeof defined match loop in as and or not elif when until unless foreach synchronized func fn def class throw case constructor where Fn FnMut FnOnce defer go select alignof decltype static_assert noexcept const type var async".split())


class Outline:
    def __init__(self, text: str, lang: str) -> None:
        self.text, self.lang, self.out = text, lang, []
        family = FAMILY.get(lang, lang)
        toks: list[tuple[str, str, int, bool]] = []
        lex, at, nl, stack = LEX[family], 0, True, []
        self.close: dict[int, int] = {}
        if lang == "php":
            start = text.find("<?php")
            at = start + 5 if start >= 0 else len(text)
        while True:
            m = lex.search(text, at)
            if m is None:
                break
            nl = nl or "\n" in text[at : m.start()]
            kind, v = m.lastgroup, m.group()
            if kind not in ("skip", "pre", "str", "id", "num", "op"):
                kind = "str"
            if family == "js" and v[0] == "/" and kind == "op" and (not toks or toks[-1][1] in BEFORE_VALUE or (toks[-1][0] == "op" and toks[-1][1] not in ")]}")) and (r := REGEX.match(text, m.start())):
                kind, m = "str", r
                v = m.group()
            at = m.end()
            if kind == "skip" or (kind == "pre" and family != "c"):
                nl = nl or "\n" in v
                continue
            if kind == "op":
                if v in "([{":
                    stack.append(len(toks))
                elif v in ")]}" and stack:
                    self.close[stack.pop()] = len(toks)
            toks.append((kind, v, m.start(), nl))
            nl = False
        for k in stack:
            self.close[k] = len(toks)
        self.t = toks
        self.n = len(toks)

    def v(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < self.n else ""

    def k(self, i: int) -> str:
        return self.t[i][0] if 0 <= i < self.n else ""

    def nl(self, i: int) -> bool:
        return i >= self.n or self.t[i][3]

    def skip(self, i: int) -> int:
        return self.close[i] + 1 if i in self.close else i + 1

    def angle(self, i: int) -> int:
        """Behind type arguments at i, or i where there are none."""
        if self.v(i) != "<":
            return i
        depth, j = 0, i
        while j < self.n and j < i + 200:
            v = self.v(j)
            depth += (v == "<") - (v == ">")
            if v in (">=", ">>="):
                depth -= 1
            if depth == 0:
                return j + 1
            if v in (";", "{", ")"):
                return i
            j = self.skip(j) if v in "([" else j + 1
        return i

    def emit(self, i: int, kind: str, name: str | None = None) -> None:
        if i >= self.n:
            return
        self.out.append((self.t[i][2], CAPTURE_KINDS.get(kind, kind), name or self.v(i), False))

    def ref(self, i: int, kind: str) -> None:
        self.out.append((self.t[i][2], kind, self.v(i), True))

    def until(self, i: int, stops: str, hi: int) -> int:
        """The next stop at this depth."""
        while i < hi and self.v(i) not in stops.split(" "):
            i = self.skip(i)
        return min(i, hi)

    def dotted(self, i: int, sep: str = ".") -> tuple[str, int]:
        """A qualified name and the place behind it."""
        j = i
        while self.k(j) == "id" and self.v(j + 1) in sep.split(" ") and self.k(j + 2) == "id":
            j += 2
        return (self.text[self.t[i][2] : self.t[j][2] + len(self.v(j))] if self.k(i) == "id" else "", j + 1)

    def calls(self, dotted: bool, scoped: bool = False, no: set[int] | None = None) -> None:
        defined = {p for p, _, _, r in self.out if not r}
        for i in range(self.n - 1):
            if self.k(i) == "id" and self.v(i + 1) == "(" and self.v(i) not in NO_CALL and self.t[i][2] not in defined and not (no and i in no):
                p = self.v(i - 1)
                if self.lang in ("c", "cpp") and self.k(i - 1) == "id" and p not in ("return", "else", "case", "do", "throw", "co_return", "co_await", "co_yield"):
                    continue
                if p in ("~", "new", "function", "fn", "func", "def", "class", "@", "record") or (p in (".", "?.", "->") and not dotted) or (p == "::" and not scoped) or self.v(i)[0] in "#$" and self.lang in ("php",):
                    continue
                if p == "*" and self.v(i - 2) == "function":
                    continue
                self.ref(i, "call")

    # languages
    def rs(self) -> None:
        quiet: set[int] = set()
        kinds = {"struct": "struct", "enum": "enum", "trait": "trait", "mod": "module"}
        i = 0
        while i < self.n:
            v = self.v(i)
            if v == "#" and (self.v(i + 1) == "[" or self.v(i + 2) == "["):
                a = i + 1 if self.v(i + 1) == "[" else i + 2
                quiet.update(range(i, self.skip(a)))
                i = self.skip(a)
                continue
            if v == "macro_rules":
                body = self.until(i, "{ ( [", self.n)
                quiet.update(range(i, self.skip(body)))
                i = self.skip(body)
                continue
            if self.k(i) == "id" and self.k(i + 1) == "id":
                if v in kinds:
                    self.emit(i + 1, kinds[v])
                    if v in ("enum", "struct"):
                        j = self.until(i + 2, "{ ; (", self.n)
                        quiet.update(range(i, self.skip(j)))
                elif v == "fn":
                    j = self.until(self.skip(self.until(i + 2, "(", self.n)), "{ ;", self.n)
                    if self.v(j) == "{":
                        self.emit(i + 1, "function")
                    quiet.add(i + 1)
                elif v == "type" and "=" in (self.v(j := self.until(i + 2, "= ;", self.n)),):
                    self.emit(i + 1, "type")
                elif v == "const" and self.v(i - 1) != "*" and self.v(i + 2) == ":":
                    self.emit(i + 1, "constant")
                elif v == "static":
                    a = i + 2 if self.v(i + 1) == "mut" else i + 1
                    if self.v(a + 1) == ":":
                        self.emit(a, "variable")
            i += 1
        self.calls(False, True, quiet)

    def value_kind(self, i: int) -> str | None:
        """function or variable by the value of a JavaScript declarator at i, or None."""
        if self.v(i) == "async":
            i += 1
        if self.v(i) == "function":
            return "function"
        j = self.angle(i)
        if self.v(j) == "(":
            j = self.skip(j)
            if self.v(j) == ":":
                while j < self.n and self.v(j) not in ("=>", ";", "=", ",") and not self.nl(j):
                    j = self.skip(j)
            return "function" if self.v(j) == "=>" else None
        if self.k(i) == "id":
            return "function" if self.v(i + 1) == "=>" else None
        single = self.nl(i + 1) or self.v(i + 1) in (";", ",", ")")
        return "variable" if single and (self.k(i) == "num" or (self.k(i) == "str" and self.v(i)[0] in "\"'")) else None

    def js(self) -> None:
        ts = self.lang in ("ts", "tsx")
        bodies: dict[int, int] = {}
        signs: set[int] = set()
        for i in range(self.n):
            v, p = self.v(i), self.v(i - 1)
            starts = i == 0 or self.nl(i) or p in (";", "}", "{", ")", "export", "default", "async", "declare", "abstract")
            if self.k(i) != "id" or p in (".", "?."):
                if v == "{" and (p in ("=", "(", ",", ":", "[", "?", "return", "&&", "||", "??") and not (p == ":" and self.v(i - 2) == ")")):
                    bodies.setdefault(i, 0)
                continue
            if v == "function" and starts:
                a = i + 2 if self.v(i + 1) == "*" else i + 1
                if self.k(a) == "id":
                    self.emit(a, "function")
            elif v == "class" and self.k(i + 1) == "id":
                if starts and p != "abstract":
                    self.emit(i + 1, "class")
                bodies[self.until(i + 1, "{", self.n)] = 1
            elif v == "class":
                bodies[self.until(i + 1, "{", self.n)] = 1
            elif ts and v == "interface" and starts and self.k(i + 1) == "id":
                self.emit(i + 1, "interface")
                body = self.until(i + 2, "{", self.n)
                signs.update(range(body, self.skip(body)))
            elif ts and v == "type" and starts and self.k(i + 1) == "id" and self.v(i + 2) in ("=", "<"):
                self.emit(i + 1, "type")
                end = self.until(i + 2, ";", self.n)
                signs.update(range(i, min(end, i + 200)))
            elif v in ("const", "let", "var") and (starts or p == "(") and not (ts and v == "var"):
                j = i + 1
                while self.k(j) == "id":
                    a = j + 1
                    if ts and self.v(a) == ":":
                        a = self.until(a, "= ; ,", self.n)
                    if self.v(a) != "=":
                        break
                    kind = self.value_kind(a + 1)
                    if kind:
                        self.emit(j, kind)
                    if kind != "variable" or self.v(a + 2) != ",":
                        break
                    j = a + 3
            elif v == "import" and starts and self.v(i + 1) not in ("(", "."):
                j = i + 1
                while j < self.n and self.k(j) != "str" and self.v(j) != ";":
                    j = self.skip(j)
                if self.k(j) == "str":
                    self.emit(j, "import")
            elif v == "export":
                a = i + 2 if self.v(i + 1) == "type" else i + 1
                if self.v(a) == "{":
                    j = a + 1
                    while j < self.close.get(a, self.n):
                        if self.k(j) == "id":
                            self.emit(j, "export")
                            self.ref(j, "export")
                        j = self.until(j, ",", self.close.get(a, self.n)) + 1
        for body, of_class in bodies.items():
            if body not in self.close:
                continue
            j, hi = body + 1, self.close[body]
            while j < hi:
                a = j
                while self.v(a) == "@":
                    a = self.skip(a + 2) if self.v(a + 2) == "(" else a + 2
                while self.v(a) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*", "accessor") and self.v(a + 1) not in ("(", "=", ";", ":", ","):
                    a += 1
                b = self.angle(a + 1)
                if self.k(a) == "id" and self.v(b) == "(":
                    e = self.skip(b)
                    while e < hi and self.v(e) not in ("{", ";", ",", "=>") and not (self.nl(e) and self.v(e) != "{"):
                        e = self.skip(e) if self.v(e) != "{" else e
                    if self.v(e) == "{" and self.v(a)[0] != "#" and self.v(a) not in ("if", "for", "while", "switch", "catch", "function"):
                        self.emit(a, "method")
                    signs.add(a)
                    j = e + 1 if self.v(e) in (";", ",") else self.skip(e) if self.v(e) == "{" else e
                    if self.v(j) == ",":
                        j += 1
                    j = max(j, a + 1)
                else:
                    j = self.field_end(a, hi, bool(of_class))
        self.calls(True, False, signs)

    def field_end(self, i: int, hi: int, of_class: bool) -> int:
        """Behind a field or a property."""
        j = i
        while j < hi and self.v(j) not in (";", ","):
            if of_class and j > i and self.nl(j) and self.v(j) not in ("{", ".", "=", "=>") and self.v(j - 1) not in ("=", "=>", ",", "(", "+"):
                return j
            j = self.skip(j)
        return j + 1

    def java(self) -> None:
        self.quiet: set[int] = set()
        self.typed_members(0, self.n, "", {"class": "class", "interface": "interface", "enum": "enum", "record": "type", "@interface": "interface"})
        self.calls(True, False, self.quiet)

    def cs(self) -> None:
        self.typed_members(0, self.n, "", {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "record": "type", "namespace": "module"})

    def typed_members(self, lo: int, hi: int, owner: str, kinds: dict[str, str]) -> None:
        """Declarations of Java or C# between two places: types, methods, constructors, fields, properties."""
        cs = self.lang == "cs"
        i = lo
        while i < hi:
            v = self.v(i)
            if v == "import" and not cs or (cs and v == "using" and not owner and self.v(i + 1) != "("):
                a = i + 2 if self.v(i + 1) in ("static", "global") else i + 1
                if cs and self.v(a + 1) == "=":
                    a += 2
                name, _ = self.dotted(a)
                if name:
                    self.emit(a, "import", name)
                i = self.until(i, ";", hi) + 1
                continue
            if v == "package":
                i = self.until(i, ";", hi) + 1
                continue
            if v == "@" and self.v(i + 1) != "interface":
                _, i = self.dotted(i + 1)
                i = self.skip(i) if self.v(i) == "(" else i
                continue
            if v == "[" or v == ";" or v == "{":
                i = self.skip(i)
                continue
            j, name, kind = i, -1, ""
            while j < hi and self.v(j) not in (";", "{", "=", "(", "=>", "}", ","):
                w = self.v(j)
                if w in kinds and self.k(j) == "id" and self.k(j + 1) == "id" and not (w == "record" and self.v(j + 2) not in ("(", "<", "{", ":", ";") and not (self.v(j + 1) in ("struct", "class"))):
                    kind, name = kinds[w], j + 1
                    if w == "record" and self.v(name) in ("struct", "class"):
                        name += 1
                    break
                if self.v(j) == "@" and self.v(j + 1) != "interface":
                    _, j = self.dotted(j + 1)
                    j = self.skip(j) if self.v(j) == "(" else j
                    continue
                j = max(self.angle(j), j + 1) if w == "<" else self.skip(j) if w == "[" else j + 1
            if kind:
                title = self.v(name)
                if kind == "module":
                    title, behind = self.dotted(name)
                    self.emit(name, kind, title)
                    if self.v(behind) == ";":
                        i = behind + 1
                        continue
                else:
                    self.emit(name, kind)
                body = self.until(name, "{ ;", hi)
                if self.v(body) == "{":
                    end = self.close.get(body, hi)
                    if kind == "enum":
                        rest = self.until(body + 1, ";", end)
                        if not cs:
                            self.quiet.update(k for k in range(body + 1, rest) if self.v(k - 1) in ("{", ",", ")"))
                        self.typed_members(rest + 1, end, title, kinds)
                    else:
                        self.typed_members(body + 1, end, "" if kind == "module" else title, kinds)
                i = self.skip(body)
                continue
            stop = self.v(j)
            named = j - 1
            if self.v(named) == ">":
                while named > i and self.v(named) != "<":
                    named -= 1
                named -= 1
            if owner and stop == "(" and self.k(named) == "id" and named >= i:
                after = self.until(self.skip(j), "{ ; => =", hi)
                if self.v(named) == owner or named > i:
                    self.emit(named, "constructor" if self.v(named) == owner else "method")
                i = self.until(after, ";", hi) + 1 if self.v(after) in ("=>", "=") else self.skip(after)
                continue
            if owner and self.k(named) == "id" and named > i and (stop in ("=", ";", ",") or (cs and stop in ("{", "=>"))):
                while True:
                    self.emit(named, "property" if stop in ("{", "=>") else "field")
                    if stop in ("{", "=>"):
                        end = self.skip(j) if stop == "{" else self.until(j, ";", hi) + 1
                        j = self.until(end, ";", hi) if stop == "{" and self.v(end) == "=" else end - 1
                        break
                    j = self.until(j, ", ;", hi) if stop == "=" else j
                    if self.v(j) != "," or self.k(j + 1) != "id":
                        break
                    named = j + 1
                    j = self.until(named, "= , ;", hi)
                    stop = self.v(j)
                i = j + 1
                continue
            i = self.skip(j) if j < hi else hi

    def go(self) -> None:
        quiet: set[int] = set()
        if self.v(0) == "package" and self.k(1) == "id":
            self.emit(1, "module")

        def each(i: int) -> list[int]:
            """Places where the entries of a declaration start."""
            if self.v(i + 1) != "(":
                return [i + 1]
            out, j = [], i + 2
            while j < self.close.get(i + 1, self.n):
                if self.nl(j) or self.v(j - 1) in ("(", ";"):
                    out.append(j)
                j = self.skip(j)
            return out

        i = 0
        while i < self.n:
            v = self.v(i)
            if v == "import" and self.nl(i):
                for a in each(i):
                    s = a if self.k(a) == "str" else a + 1
                    if self.k(s) == "str":
                        self.emit(s, "import")
            elif v == "func" and self.nl(i):
                a = self.skip(i + 1) if self.v(i + 1) == "(" else i + 1
                if self.k(a) == "id":
                    self.emit(a, "method" if a > i + 1 else "function")
            elif v == "type" and self.nl(i):
                for a in each(i):
                    b = a + 1
                    if self.v(b) == "[" and self.k(b + 1) == "id" and self.v(b + 2) not in ("]",):
                        b = self.skip(b)
                    if self.k(a) == "id" and self.v(b) != "=":
                        self.emit(a, {"struct": "struct", "interface": "interface"}.get(self.v(b), "type"))
                        if self.v(b) == "interface":
                            quiet.update(range(b, self.skip(b + 1)))
            elif v in ("const", "var") and self.nl(i):
                for a in each(i):
                    while self.k(a) == "id":
                        self.emit(a, "constant" if v == "const" else "variable")
                        if self.v(a + 1) != ",":
                            break
                        a += 2
            i += 1
        self.calls(True, False, quiet)

    def c(self) -> None:
        cpp = self.lang == "cpp"
        quiet: set[int] = set()
        for _, v, pos, _ in [x for x in self.t if x[0] == "pre"]:
            m = re.match(r"\s*#\s*include\s*(<[^>\n]+>|\"[^\"\n]+\")", v)
            if m:
                self.out.append((pos + m.start(1), "import", m.group(1), False))
        self.t = [x for x in self.t if x[0] != "pre"]
        self.n, self.close, stack = len(self.t), {}, []
        for k, (kind, v, _, _) in enumerate(self.t):
            if kind == "op" and v in "([{":
                stack.append(k)
            elif kind == "op" and v in ")]}" and stack:
                self.close[stack.pop()] = k
        for k in stack:
            self.close[k] = self.n
        self.c_block(0, self.n, "", cpp, quiet)
        self.calls(True if cpp else False, False, quiet)

    def c_block(self, lo: int, hi: int, owner: str, cpp: bool, quiet: set[int]) -> None:
        i = lo
        while i < hi:
            v = self.v(i)
            if v in (";", "}", ":") or (v in ("public", "private", "protected") and self.v(i + 1) == ":"):
                i += 1
                continue
            if cpp and v == "namespace":
                name, b = self.dotted(i + 1, "::")
                if name and self.v(b) == "{":
                    self.emit(i + 1, "namespace", name)
                b = self.until(b, "{ ;", hi)
                if self.v(b) == "{":
                    self.c_block(b + 1, self.close[b], "", cpp, quiet)
                i = self.skip(b)
                continue
            if cpp and v == "template":
                i = max(self.angle(i + 1), i + 1)
                continue
            if v == "extern" and self.k(i + 1) == "str":
                i += 2
                if self.v(i) == "{":
                    self.c_block(i + 1, self.close[i], "", cpp, quiet)
                    i = self.skip(i)
                continue
            if v in ("using", "return", "goto", "break", "continue", "case", "default", "friend", "static_assert"):
                i = self.until(i, ";", hi) + 1
                continue
            if v == "{":
                self.c_block(i + 1, self.close[i], owner, cpp, quiet)
                i = self.skip(i)
                continue
            if v in ("if", "for", "while", "switch", "else", "do", "catch", "try"):
                i = self.skip(i + 1) if self.v(i + 1) == "(" else i + 1
                continue
            typedef = v == "typedef"
            j, last = i, -1
            while j < hi and self.v(j) not in (";", "{", "(", "=", ","):
                w = self.v(j)
                if w in ("struct", "union", "enum", "class") and (w != "class" or cpp):
                    a = j + 2 if self.v(j + 1) in ("class", "struct") else j + 1
                    body = self.until(a, "{ ; ( = ) ,", hi)
                    named = self.k(a) == "id"
                    kind = {"struct": "struct", "union": "type", "enum": "enum", "class": "class"}[w]
                    if named and (self.v(body) == "{" or w == "enum" or (w == "class" and self.v(a + 1) in (";", ":"))) and self.v(body) != "(":
                        self.emit(a, kind)
                    if self.v(body) == "{" and self.v(a + 1 if named else a) in ("{", ":", "final"):
                        if w == "enum":
                            quiet.update(range(body, self.close[body]))
                        else:
                            self.c_block(body + 1, self.close[body], self.v(a) if named else "?", cpp, quiet)
                        j = self.skip(body)
                    else:
                        j = a + 1
                    continue
                if self.k(j) == "id":
                    last = j
                j = max(self.angle(j), j + 1) if w == "<" and cpp else self.skip(j) if w == "[" else j + 1
            stop = self.v(j)
            if typedef:
                end = self.until(j, ";", hi)
                a = end - 1
                if stop == "(" and self.v(j + 1) == "*":
                    a = j + 2
                while a > i and self.k(a) != "id":
                    a -= 1
                if a > i:
                    self.emit(a, "type")
                i = end + 1
                continue
            if stop == "(" and last == j - 1 and (last > i or (owner and self.v(last) == owner) or self.v(last - 1) in ("::", "~")):
                end = self.skip(j)
                b = self.until(end, "{ ; , =" if self.v(end) != ":" else "{ ;", hi) if cpp else end
                quiet.update(range(end, b))
                inner = self.v(j + 1)
                vexing = self.k(j + 1) in ("num", "str") or (lo and not owner and self.v(b) == ";" and inner != ")" and self.k(j + 2) != "id" and inner != "void")
                if self.v(last - 1) == "::":
                    if cpp:
                        self.emit(last, "method")
                elif not vexing and self.v(last - 1) not in (".", "->", "=", "return", "~"):
                    self.emit(last, "method" if cpp and owner else "function")
                if self.v(b) == "{":
                    self.c_block(b + 1, self.close[b], "", cpp, quiet)
                    i = self.skip(b)
                else:
                    i = self.until(b, ";", hi) + 1
                continue
            if stop in ("=", ",", ";") and last > i and last == j - 1 - (self.close.get(last + 1, last) - last if self.v(last + 1) == "[" else 0) and not owner:
                if stop == "=":
                    self.emit(last, "variable")
                i = self.until(j, ";", hi) + 1
                continue
            if stop == "{" and cpp and last > i and not owner:
                i = self.skip(j)
                continue
            i = self.skip(j) if stop in ("{", "(") else j + 1

    cpp = c

    def php(self) -> None:
        kinds = {"interface": "interface", "trait": "trait", "class": "class", "enum": "enum"}
        typed: list[tuple[int, int]] = []
        for i in range(self.n):
            v, p = self.v(i).lower(), self.v(i - 1)
            if self.k(i) != "id" or p in ("->", "::", "?->"):
                continue
            if v == "namespace" and self.k(i + 1) == "id":
                name, _ = self.dotted(i + 1, "\\")
                self.emit(i + 1, "module", name)
            elif v in kinds and self.k(i + 1) == "id" and p != "new" and self.v(i + 1) not in ("extends", "implements"):
                self.emit(i + 1, kinds[v])
                b = self.until(i + 2, "{ ;", self.n)
                typed.append((b, self.close.get(b, b)))
            elif v == "function":
                a = i + 2 if self.v(i + 1) == "&" else i + 1
                if self.k(a) == "id" and self.v(a + 1) == "(":
                    self.emit(a, "method" if any(lo < i < hi for lo, hi in typed) else "function")
            elif v == "const" and self.k(i + 1) == "id":
                a = i + 1
                while self.v(a + 1) != "=" and self.k(a + 1) == "id":
                    a += 1
                self.emit(a, "constant")
            elif v in ("include", "include_once", "require", "require_once") and self.v(i + 1):
                end = self.until(i + 1, ";", self.n)
                a = i + 1
                self.out.append((self.t[a][2], "import", self.text[self.t[a][2] : self.t[end - 1][2] + len(self.v(end - 1))], False))
            elif v in ("public", "protected", "private", "var", "static", "readonly"):
                a = i + 1
                while self.k(a) == "id" and self.v(a)[0] != "$" and self.v(a) not in ("function", "const") or self.v(a) in ("?", "|"):
                    a += 1
                if self.v(a)[:1] == "$" and self.v(i - 1) not in ("public", "protected", "private", "static", "readonly", "var") and any(lo < i < hi for lo, hi in typed) and self.v(a + 1) in ("=", ";", ","):
                    self.out.append((self.t[a][2] + 1, "variable", self.v(a)[1:], False))

    def kt(self) -> None:
        def name_at(i: int) -> int:
            j = self.angle(i)
            while self.k(j) == "id" and self.v(self.angle(j + 1)) == "." and self.k(self.angle(j + 1) + 1) == "id":
                j = self.angle(j + 1) + 1
            return j if self.k(j) == "id" else -1

        for i in range(self.n):
            v, p = self.v(i), self.v(i - 1)
            if self.k(i) != "id" or p in (".", "::", "?."):
                continue
            if v in ("package", "import") and self.nl(i):
                name, _ = self.dotted(i + 1)
                if name:
                    self.emit(i + 1, "module" if v == "package" else "import", name)
            elif v in ("class", "interface") and self.k(i + 1) == "id":
                self.emit(i + 1, "class")
                if p == "enum":
                    b = self.until(i + 2, "{", self.n)
                    j = b + 1
                    while b in self.close and j < self.close[b] and self.v(j) != ";":
                        if self.k(j) == "id":
                            self.emit(j, "enum")
                        j = self.until(j, ", ;", self.close[b]) + (self.v(self.until(j, ", ;", self.close[b])) == ",")
                        if self.v(j) == ";":
                            break
            elif v == "object" and self.k(i + 1) == "id" and p != ":":
                self.emit(i + 1, "object")
            elif v == "fun" and (a := name_at(i + 1)) >= 0:
                self.emit(a, "function")
            elif v in ("val", "var") and p not in ("(", ",") and (a := name_at(i + 1)) >= 0 and not self.in_parens(i):
                self.emit(a, "property")
            elif v == "typealias" and self.k(i + 1) == "id":
                self.emit(i + 1, "type")

    def in_parens(self, i: int) -> bool:
        """Inside parentheses that no brace inside them holds."""
        if not hasattr(self, "_parens"):
            self._parens, stack = [False] * self.n, []
            for k in range(self.n):
                v = self.v(k) if self.k(k) == "op" else ""
                if v in (")", "]", "}") and stack:
                    stack.pop()
                self._parens[k] = bool(stack) and stack[-1] == "("
                if v in ("(", "[", "{"):
                    stack.append(v)
        return self._parens[i]

    def scala(self) -> None:
        kinds = {"trait": "trait", "enum": "enum", "class": "class", "object": "object", "def": "function", "val": "constant", "var": "variable", "type": "type"}
        for i in range(self.n):
            v, p = self.v(i), self.v(i - 1)
            if self.k(i) != "id" or p == ".":
                continue
            if v in ("package", "import") and self.nl(i):
                if v == "package" and self.v(i + 1) == "object":
                    continue
                name, _ = self.dotted(i + 1)
                if name:
                    self.emit(i + 1, "module" if v == "package" else "import", name if v == "package" else None)
            elif v in kinds and self.k(i + 1) == "id" and not (v in ("val", "var") and self.in_parens(i)) and not (v == "class" and self.v(i + 1) == "of"):
                if v == "type" and self.v(self.until(i + 2, "= ; }", self.n)) != "=" and self.nl(i + 2):
                    continue
                self.emit(i + 1, kinds[v])

    def swift(self) -> None:
        kinds = {"class": "class", "struct": "struct", "enum": "enum", "protocol": "interface", "typealias": "type"}

        def block(lo: int, hi: int, scope: str) -> None:
            i = lo
            while i < hi:
                v = self.v(i)
                if self.k(i) == "id" and self.v(i - 1) != ".":
                    if v == "import" and self.nl(i):
                        a = i + 1
                        while self.v(a + 1) == "." or (self.k(a + 1) == "id" and not self.nl(a + 1)):
                            a += 1
                        if self.k(a) == "id":
                            self.emit(a, "import")
                        i = a + 1
                        continue
                    if v in kinds and self.k(i + 1) == "id" and self.v(i + 1) not in ("func", "var", "let"):
                        self.emit(i + 1, kinds[v])
                        if v == "typealias":
                            i += 2
                            continue
                        b = self.until(i + 2, "{", hi)
                        if b < hi:
                            block(b + 1, self.close[b], "none" if v == "protocol" else v)
                        i = self.skip(b)
                        continue
                    if v == "extension":
                        b = self.until(i + 1, "{", hi)
                        if b < hi:
                            block(b + 1, self.close[b], "class")
                        i = self.skip(b)
                        continue
                    if v in ("func", "init", "deinit", "subscript"):
                        if v == "func" and self.k(i + 1) == "id" and scope in ("top", "class", "struct"):
                            self.emit(i + 1, "function" if scope == "top" else "method")
                        j = i + 1
                        while j < hi and self.v(j) != "{" and not (j > i + 2 and self.nl(j) and self.v(j) not in ("->", "where", "throws", "async", "rethrows", "(")):
                            j = self.skip(j)
                        if self.v(j) == "{":
                            block(j + 1, self.close[j], "none")
                            j = self.skip(j)
                        i = j
                        continue
                    if v in ("let", "var") and self.k(i + 1) == "id":
                        if scope in ("top", "class", "struct"):
                            self.emit(i + 1, "variable" if scope == "top" else "property")
                        i += 2
                        continue
                if v == "{":
                    block(i + 1, self.close[i], "none")
                    i = self.skip(i)
                    continue
                i = self.skip(i)

        block(0, self.n, "top")

    def dart(self) -> None:
        kinds = {"class": "class", "mixin": "class", "extension": "type", "enum": "enum"}

        def block(lo: int, hi: int, owner: str) -> None:
            i = lo
            while i < hi:
                v = self.v(i)
                if v == "@":
                    _, i = self.dotted(i + 1)
                    i = self.skip(i) if self.v(i) == "(" else i
                    continue
                if v in ("import", "export", "part", "library") and not owner:
                    if self.k(i + 1) == "str" and v in ("import", "export"):
                        self.emit(i + 1, v)
                    i = self.until(i, ";", hi) + 1
                    continue
                if v == "typedef":
                    self.emit(i + 1, "type")
                    i = self.until(i, ";", hi) + 1
                    continue
                a = i + 1 if v in ("abstract", "sealed", "base", "final", "interface") and self.v(i + 1) in ("class", "mixin") else i
                if self.v(a) in kinds and self.k(a + 1) == "id" and not owner:
                    name = a + 2 if self.v(a) == "mixin" and self.v(a + 1) == "class" else a + 1
                    if self.v(name) != "on":
                        self.emit(name, kinds[self.v(a)])
                    b = self.until(name, "{ ;", hi)
                    if self.v(b) == "{":
                        first = b + 1
                        if self.v(a) == "enum":
                            while first < self.close[b] and self.v(first) != ";":
                                if self.k(first) == "id":
                                    self.emit(first, "constant")
                                first = self.until(first, ", ;", self.close[b])
                                first += self.v(first) == ","
                        block(first, self.close[b], self.v(name))
                    i = self.skip(b)
                    continue
                j, last, get = i, -1, False
                while j < hi and self.v(j) not in (";", "{", "(", "=", "=>", ","):
                    if self.v(j) in ("get", "set") and self.k(j + 1) == "id":
                        get = True
                    if self.k(j) == "id":
                        last = j
                    j = max(self.angle(j), j + 1) if self.v(j) == "<" else self.skip(j) if self.v(j) == "[" else j + 1
                stop, words = self.v(j), {self.v(k) for k in range(i, j)}
                if stop == "(" or get:
                    if owner and last >= 0 and (self.v(last) == owner or (self.v(last - 1) == "." and self.v(last - 2) == owner)):
                        self.emit(last if self.v(last) == owner else last - 2, "constructor")
                    elif last > i or (owner and last == i):
                        self.emit(last, "method" if owner else "function")
                    e = self.until(self.skip(j) if stop == "(" else j, "{ ; =>", hi)
                    i = self.until(e, ";", hi) + 1 if self.v(e) == "=>" else self.skip(e)
                    continue
                if last > i and stop in ("=", ";", ",") and not owner:
                    if stop == "=":
                        self.emit(last, "constant" if words & {"const", "final"} else "variable")
                i = self.until(j, ";", hi) + 1 if stop != "{" else self.skip(j)

        block(0, self.n, "")

    def rb(self) -> None:
        for i in range(self.n):
            v, p = self.v(i), self.v(i - 1)
            if self.k(i) != "id" or p in (".", ":", "::", "&."):
                continue
            if v in ("class", "module") and (self.nl(i) or p == ";") and self.v(i + 1)[:1].isupper():
                name, end = self.dotted(i + 1, "::")
                self.emit(end - 1, v)
            elif v == "def":
                a = i + 1
                if self.v(a + 1) == ".":
                    a += 2
                if self.k(a) == "id":
                    self.emit(a, "method")
            elif v[:1].isupper() and self.v(i + 1) == "=" and self.nl(i):
                self.emit(i, "constant")

    def sh(self) -> None:
        for i in range(self.n):
            v = self.v(i)
            if self.k(i) != "id":
                continue
            starts = self.nl(i) or self.v(i - 1) in (";", "&&", "||", "{", "(", "then", "do", "else", "local", "export", "readonly", "declare", "typeset")
            if v == "function" and self.k(i + 1) == "id":
                self.emit(i + 1, "function")
            elif starts and self.v(i + 1) == "(" and self.v(i + 2) == ")" and self.v(i - 1) != "function":
                self.emit(i, "function")
            elif starts and re.fullmatch(r"\w+", v) and self.text[self.t[i][2] + len(v) : self.t[i][2] + len(v) + 2].startswith(("=", "+=")) and not self.text.startswith("==", self.t[i][2] + len(v)):
                self.emit(i, "variable")

    def nix(self) -> None:
        for i in range(self.n):
            if self.k(i) != "id" or self.v(i + 1) != "=" or self.v(i - 1) in ("?", ","):
                continue
            a = i + 2
            if self.v(a) == "import" and self.v(a + 1) != ";":
                self.emit(i, "import")
            elif self.v(a) in ("{", "rec", "let"):
                b = a + 1 if self.v(a) != "{" else a
                after = self.skip(b)
                if self.v(a) == "{" and self.v(after) in (":", "@"):
                    self.emit(i, "function")
                elif self.v(a) != "let" or self.v(b) == "{":
                    self.emit(i, "module")
            elif self.k(a) == "id" and self.v(a + 1) in (":", "@"):
                self.emit(i, "function")


def outline(text: str, lang: str) -> list[Row]:
    """Rows of a text; lang is a language id other than py."""
    o = Outline(text, lang)
    getattr(o, FAMILY.get(lang, lang))()
    return sorted(set(o.out))


OUTLINES: dict[str, Callable[[str], list[Row]]] = {lang: (lambda text, lang=lang: outline(text, lang)) for lang in set(LANGUAGES.values()) - {"py"}}
