"""Grammar of YAML streams: block and flow nodes, all scalar styles, documents, properties."""

from __future__ import annotations

import re

from waymark.llm.syntax.base import Bad

ILLEGAL = re.compile("[^\t\n\r\x20-\x7e\x85\xa0-\ud7ff\ue000-�\U00010000-\U0010ffff]")
DOUBLE = re.compile(r"\"(?:[^\"\\]|\\(?:[0abt\tnvfre \"/\\N_LP\n]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|\r\n))*\"")
SINGLE = re.compile(r"'(?:[^']|'')*'")
PROPERTY = re.compile(r"(?:&[^\s,\[\]{}]+|!<[^>\s]*>|![^\s,\[\]{}]*)(?:\s+|$)")
HEADER = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?\s*(?:\s#.*)?$")
KEY_END = re.compile(r":(?=\s|$)")
CANNOT_START = set(",[]{}#&*!|>'\"%@`")


class Yaml:
    def __init__(self, text: str) -> None:
        if text.startswith("\ufeff"):
            text = text[1:]
        m = ILLEGAL.search(text)
        if m:
            raise Bad(text.count("\n", 0, m.start()) + 1, "illegal character")
        self.lines = re.split(r"\r\n|\n|\r", text)
        self.i = 0
        self.held: tuple[int, str] | None = None  # the rest of a line, as if it stood alone

    def fail(self, why: str) -> None:
        raise Bad(self.i + 1, why)

    def peek(self) -> tuple[int, str] | None:
        """(indent, content) of the next line with content, or None at a document's end."""
        if self.held is not None:
            return self.held
        while self.i < len(self.lines):
            raw = self.lines[self.i]
            body = raw.lstrip(" ")
            if not body.strip() or body.startswith("#"):
                self.i += 1
                continue
            if body[0] == "\t":
                if body.lstrip().startswith("#"):
                    self.i += 1
                    continue
                self.fail("tab in indentation")
            if re.match(r"(?:---|\.\.\.)(?:\s|$)", raw):
                return None
            return len(raw) - len(body), body.rstrip()
        return None

    def take(self) -> None:
        self.held = None
        self.i += 1

    def stream(self) -> None:
        self.document(False)
        while self.i < len(self.lines):
            raw = self.lines[self.i]
            if raw.startswith("---"):
                rest = raw[3:].strip()
                if rest and not rest.startswith("#"):
                    self.held = (len(raw) - len(raw[3:].lstrip()), rest)
                else:
                    self.i += 1
                self.document(True)
            elif raw.startswith("..."):
                self.i += 1
                self.document(False)
            else:
                self.fail("expected document")

    def document(self, explicit: bool) -> None:
        if not explicit:
            while (p := self.peek()) and p[0] == 0 and p[1].startswith("%"):
                self.take()
        if self.peek() is not None:
            self.node(-1)
        if self.peek() is not None:
            self.fail("more after the document's node")

    # block nodes
    def node(self, parent: int) -> None:
        n, s = self.peek()
        if s[0] == "-" and (len(s) == 1 or s[1] in " \t"):
            return self.sequence(n)
        m = PROPERTY.match(s)
        while m:
            s = s[m.end() :]
            if not s or s.startswith("#"):
                self.take()
                p = self.peek()
                if p is not None and p[0] > parent:
                    self.node(parent)
                return None
            if self.key(s) is not None:
                break
            self.held = (n, s)
            m = PROPERTY.match(s)
        n, s = self.peek()
        if s[0] == "?" and (len(s) == 1 or s[1] == " "):
            return self.mapping(n)
        if self.key(s) is not None:
            return self.mapping(n)
        self.held = (n, s)
        return self.scalar(parent, n)

    def sequence(self, n: int) -> None:
        while (p := self.peek()) and p[0] == n and (p[1] == "-" or p[1][:2] in ("- ", "-\t")):
            rest = p[1][1:].lstrip()
            if not rest or rest.startswith("#"):
                self.take()
                q = self.peek()
                if q is not None and q[0] > n:
                    self.node(n)
            else:
                self.held = (n + len(p[1]) - len(rest), rest)
                self.node(n)
        p = self.peek()
        if p is not None and p[0] > n:
            self.fail("bad indentation in a sequence")

    def key(self, s: str) -> int | None:
        """Where the implicit key of a line ends (behind the colon), or None."""
        at = 0
        while m := PROPERTY.match(s, at):
            at = m.end()
        if at >= len(s):
            return None
        c = s[at]
        if c == '"' or c == "'":
            m = (DOUBLE if c == '"' else SINGLE).match(s, at)
            if m is None:
                return None
            k = re.compile(r"\s*:(?=\s|$)").match(s, m.end())
            return k.end() if k else None
        if c in "[{":
            end = self.flow_end(s, at)
            k = re.compile(r"\s*:(?=\s|$)").match(s, end) if end else None
            return k.end() if k else None
        if c == "*":
            m = re.compile(r"\*\S+\s+:(?=\s|$)").match(s, at)
            return m.end() if m else None
        if c in CANNOT_START or (c in "-?:" and (at + 1 >= len(s) or s[at + 1] in " \t") and c != ":"):
            return None
        m = KEY_END.search(s, at)
        h = re.compile(r"\s#").search(s, at)
        if m is None or (h and h.start() < m.start()):
            return None
        return m.end()

    @staticmethod
    def flow_end(s: str, at: int) -> int | None:
        depth, k = 0, at
        while k < len(s):
            c = s[k]
            if c in "\"'" and (k == at or s[k - 1] in " ,[{:\t"):
                m = (DOUBLE if c == '"' else SINGLE).match(s, k)
                if m is None:
                    return None
                k = m.end()
                continue
            depth += (c in "[{") - (c in "]}")
            k += 1
            if depth == 0:
                return k
        return None

    def mapping(self, n: int) -> None:
        while (p := self.peek()) and p[0] == n:
            s = p[1]
            if s == "?" or s.startswith("? "):
                rest = s[1:].lstrip()
                if rest:
                    self.held = (n + len(s) - len(rest), rest)
                    self.node(n)
                else:
                    self.take()
                    if (q := self.peek()) and q[0] > n:
                        self.node(n)
                if (q := self.peek()) and q[0] == n and (q[1] == ":" or q[1].startswith(": ")):
                    self.value(n, q[1][1:], q[0] + 1)
                continue
            if s[0] == "-" and (len(s) == 1 or s[1] == " "):
                self.fail("sequence inside a mapping")
            end = self.key(s)
            if end is None:
                self.fail("expected key")
            if s[0] in "[{":
                self.flow_text(s[: end - 1].rstrip())
            self.value(n, s[end:], n + end)
        p = self.peek()
        if p is not None and p[0] > n:
            self.fail("bad indentation in a mapping")

    def value(self, n: int, rest: str, col: int) -> None:
        rest = rest.strip()
        while m := PROPERTY.match(rest):
            rest = rest[m.end() :]
        if not rest or rest.startswith("#"):
            self.take()
            p = self.peek()
            if p is not None and (p[0] > n or (p[0] == n and (p[1] == "-" or p[1].startswith("- ")))):
                if p[0] == n:
                    self.sequence(n)
                else:
                    self.node(n)
            return
        self.held = (col, rest)
        if rest[0] == "-" and (len(rest) == 1 or rest[1] == " "):
            self.fail("sequence on the line of its key")
        if rest[0] not in "\"'[{|>" and KEY_END.search(re.split(r"\s#", rest)[0]):
            self.fail("mapping values are not allowed here")
        self.scalar(n, n + 1)

    def scalar(self, parent: int, _n: int) -> None:
        _, s = self.held if self.held is not None else self.peek()
        c = s[0]
        if c in "|>":
            if not HEADER.match(s):
                self.fail("bad block scalar header")
            self.take()
            first = None
            while self.i < len(self.lines):
                raw = self.lines[self.i]
                if raw.strip(" "):
                    ind = len(raw) - len(raw.lstrip(" "))
                    if ind <= parent or re.match(r"(?:---|\.\.\.)(?:\s|$)", raw):
                        break
                    if first is None:
                        first = ind
                    if ind < first and not re.match(r".*[1-9]", s):
                        if not raw.lstrip().startswith("#"):
                            break
                self.i += 1
            return
        if c in "\"'":
            return self.quoted(s, DOUBLE if c == '"' else SINGLE, parent)
        if c in "[{":
            return self.flow(s, parent)
        if c == "*":
            if not re.match(r"\*[^\s,\[\]{}]+\s*(?:#.*)?$", s):
                self.fail("bad alias")
            self.take()
            return None
        if c in CANNOT_START:
            self.fail("character cannot start a token")
        self.plain(s, parent)
        return None

    def plain(self, s: str, parent: int) -> None:
        if KEY_END.search(re.split(r"\s#", s)[0]):
            self.fail("mapping values are not allowed here")
        ended = re.search(r"\s#", s)
        self.take()
        while not ended:
            at = self.i
            while at < len(self.lines) and not self.lines[at].strip():
                at += 1
            if at >= len(self.lines):
                self.i = at
                return
            raw = self.lines[at]
            body = raw.lstrip(" \t")
            ind = len(raw) - len(raw.lstrip(" "))
            if ind <= parent or body.startswith("#") or re.match(r"(?:---|\.\.\.)(?:\s|$)", raw):
                return
            if parent < 0 and ind == 0 and False:
                return
            if KEY_END.search(re.split(r"\s#", body)[0]):
                self.i = at
                self.fail("mapping values are not allowed here")
            ended = re.search(r"\s#", body)
            self.i = at + 1

    def rest_of(self, s: str, parent: int) -> str:
        """The text from ``s`` on, with the lines that may belong to the node."""
        out = [s]
        for k in range(self.i + 1, len(self.lines)):
            out.append(self.lines[k])
        return "\n".join(out)

    def quoted(self, s: str, rx: re.Pattern, parent: int) -> None:
        text = self.rest_of(s, parent)
        m = rx.match(text)
        if m is None:
            self.fail("unterminated quoted scalar")
        inner = m.group().split("\n")[1:]
        for ln in inner:
            if re.match(r"(?:---|\.\.\.)(?:\s|$)", ln):
                self.fail("document marker in a quoted scalar")
        self.after(text, m.end(), parent)

    def after(self, text: str, end: int, parent: int) -> None:
        """Move behind a node that ended inside ``text``; only a comment may follow on its line."""
        used = text.count("\n", 0, end)
        stop = text.find("\n", end)
        tail = text[end : stop if stop >= 0 else len(text)]
        if tail.strip() and not re.match(r"\s+#", tail):
            self.i += used
            self.fail("more behind a node")
        self.held = None
        self.i += used + 1

    def flow(self, s: str, parent: int) -> None:
        text = self.rest_of(s, parent)
        end = self.flow_node(text, 0)
        self.after(text, end, parent)

    def flow_text(self, s: str) -> None:
        if self.flow_node(s, 0) != len(s):
            self.fail("bad flow key")

    # flow nodes
    def gap(self, t: str, at: int) -> int:
        while True:
            m = re.compile(r"[ \t\n]*").match(t, at)
            at = m.end()
            if at < len(t) and t[at] == "#" and (at == 0 or t[at - 1] in " \t\n"):
                stop = t.find("\n", at)
                at = len(t) if stop < 0 else stop
                continue
            if at < len(t) and (at == 0 or t[at - 1] == "\n") and re.compile(r"(?:---|\.\.\.)(?:\s|$)").match(t, at):
                self.fail("document marker in a flow collection")
            return at

    def flow_node(self, t: str, at: int) -> int:
        at = self.gap(t, at)
        while m := PROPERTY.match(t, at):
            at = self.gap(t, m.end())
        if at >= len(t):
            self.fail("flow collection not closed")
        c = t[at]
        if c in "[{":
            close = "]" if c == "[" else "}"
            at = self.gap(t, at + 1)
            while True:
                if at >= len(t):
                    self.fail("flow collection not closed")
                if t[at] == close:
                    return at + 1
                if t[at] == ",":
                    self.fail("expected node")
                if t[at] == "?" and t[at + 1 : at + 2] in (" ", "\n"):
                    at = self.gap(t, at + 1)
                if t[at] != ":" or t[at + 1 : at + 2] not in ("", " ", ",", "\n", "]", "}"):
                    at = self.gap(t, self.flow_node(t, at))
                if at < len(t) and t[at] == ":":
                    at = self.gap(t, at + 1)
                    if at < len(t) and t[at] not in ",]}":
                        at = self.gap(t, self.flow_node(t, at))
                if at >= len(t):
                    self.fail("flow collection not closed")
                if t[at] == ",":
                    at = self.gap(t, at + 1)
                elif t[at] != close:
                    self.fail("expected , or the closing bracket")
        if c in "\"'":
            m = (DOUBLE if c == '"' else SINGLE).match(t, at)
            if m is None:
                self.fail("unterminated quoted scalar")
            return m.end()
        if c in CANNOT_START and c != "*":
            self.fail("character cannot start a token")
        k = at
        while k < len(t):
            c = t[k]
            if c in ",[]{}":
                break
            if c == ":" and t[k + 1 : k + 2] in ("", " ", "\t", "\n", ",", "[", "]", "{", "}"):
                break
            if c == "#" and t[k - 1] in " \t\n":
                break
            k += 1
        if k == at:
            self.fail("expected node")
        return k


def check(text: str) -> None:
    Yaml(text).stream()
