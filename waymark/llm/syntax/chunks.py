"""Lexer-state maps and bracket summaries of file chunks.

A chunk, a run of whole lines, is read once from every lexer state that can hold at its start: code, comments,
strings that span lines, and strings continued by a backslash at the end of a line. For each such state the
summary holds what the chunk does to the stack of open brackets: the closers that match nothing inside it, the
openers it leaves open, the state at its end and the first lexical fault. Templates and nested comments are on
that stack too, so what follows their end depends on what was opened: where a chunk closes more than it opens,
its reading forks by the kind of the bracket taken off (``}`` of a block or of a template's ``${``, ``*/`` of
an outer or an inner comment).

Summaries combine associatively, so the chunks of a file can be read anywhere and reduced in any grouping; the
combination from the code state tells whether the file ends inside a string or comment and whether its
brackets match. Cuts may fall behind any line: the result is that of reading the text in one piece.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from waymark.llm.syntax import ecma

CLOSES = {")": "(", "]": "[", "}": "{$", "`": "`", "c": "cC"}
"""closer -> the openers it may take off; c stands for the end of a comment."""
AFTER = {"$": "tpl", "C": "bc"}
"""opener -> state behind its end, code unless given."""

STRING = r"(?:[^{q}\\\n]|\\(?:\r\n|[\s\S]))*+"
LINED = {q: rf"{q}{STRING.format(q=q)}(?:(?P<{ok}>{q})|(?P<{state}>(?<=\n)\Z)|(?P<{bad}>))" for q, ok, state, bad in (('"', "ok2", "s2", "bad2"), ("'", "ok1", "s1", "bad1"))}
INSIDE_LINED = {state: rf"{STRING.format(q=q)}(?:(?P<close>{q})|(?P<more>(?<=\n)\Z)|(?P<bad>))" for q, state in (('"', "s2"), ("'", "s1"))}
PLAIN2 = r"(?P<ok2>\"(?:[^\"\\\n]|\\[^\n])*+\")"
PLAIN1 = r"(?P<ok1>'(?:[^'\\\n]|\\[^\n])*+')"
UNCLOSED = r"(?P<bad>[\"'])"
SLASHES = r"(?P<skip>//[^\n]*)"
HASH = r"(?P<skip>#[^\n]*)"
SPAN_D3 = r"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\""
SPAN_S3 = r"(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
COMMENT_END = r"[\s\S]*?\*/"
RAW_STATES = {f"r{n}": rf"[^\"]*\"(?:[^\"]*\")*?{'#' * n}" if n else r"[^\"]*\"" for n in range(9)}


@dataclass(frozen=True)
class Spec:
    """code: next thing of interest in code; inside: state -> pattern to its end or next event; opens: what must stand before a chunk for it to start there."""

    code: re.Pattern
    inside: dict[str, re.Pattern] = field(default_factory=dict)
    opens: dict[str, str] = field(default_factory=dict)


def spec(parts: list[str], inside: dict[str, str], opens: dict[str, str]) -> Spec:
    return Spec(re.compile("|".join([*parts, r"(?P<b>[()\[\]{}])"])), {k: re.compile(v) for k, v in inside.items()}, opens)


REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/")
BEFORE_REGEX = frozenset("(,=:[!&|?{};\n>*%^~")
"""Signs behind which a slash opens a regular expression (fixed values)."""


def _regex_end(text: str, at: int) -> int:
    """The end of the regular expression at a slash, or 0 where the slash divides."""
    i = at - 1
    while i >= 0 and text[i] in " \t":
        i -= 1
    c = text[i] if i >= 0 else "\n"
    if c in "+-":
        opens = text[i - 1 : i] != c
    elif c.isalpha():
        k = i
        while k >= 0 and i - k < 11 and text[k].isalpha():
            k -= 1
        opens = text[k + 1 : i + 1] in ecma.EXPR_WORDS and not (k >= 0 and (text[k].isalnum() or text[k] in "_$."))
    else:
        opens = c in BEFORE_REGEX
    m = REGEX.match(text, at) if opens else None
    return m.end() if m else 0


_JS = spec(
    [SLASHES, r"(?P<bc>/\*)", LINED['"'], LINED["'"], r"(?P<tpl>`)", r"(?P<slash>/)"],
    {"bc": COMMENT_END, "tpl": r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:(?P<tick>`)|(?P<hole>\$\{))", **INSIDE_LINED},
    {"bc": "/*", "tpl": "`"},
)
SPECS = {
    "py": spec(
        [HASH, r"(?P<d3>\"\"\")", r"(?P<s3>''')", LINED['"'], LINED["'"]],
        {"d3": SPAN_D3, "s3": SPAN_S3, **INSIDE_LINED},
        {"d3": '"""', "s3": "'''"},
    ),
    "js": _JS,
    "ts": _JS,
    "go": spec([SLASHES, r"(?P<bc>/\*)", PLAIN2, r"(?P<ok1>'(?:[^'\\\n]|\\[^\n]+?)')", r"(?P<raw>`)", UNCLOSED], {"bc": COMMENT_END, "raw": r"[^`]*`"}, {"bc": "/*", "raw": "`"}),
    "rs": spec(
        [SLASHES, r"(?P<bc>/\*)", r"(?P<hashed>\b[bc]?r#*\")", r"(?P<ok1>'(?:[^'\\\n]|\\(?:[^u\n]|u\{[^}\n]*\}|x..))'|'[^\W\d]\w*)", r"(?P<st>\")", r"(?P<bad>')"],
        {"bc": r"[\s\S]*?(?:(?P<end>\*/)|(?P<inner>/\*))", "st": r"(?:[^\"\\]|\\[\s\S])*+\"", **RAW_STATES},
        {"bc": "/*", "st": '"', **{f"r{n}": f'r{"#" * n}"' for n in range(9)}},
    ),
    "java": spec([SLASHES, r"(?P<bc>/\*)", r"(?P<d3>\"\"\")", PLAIN2, PLAIN1, UNCLOSED], {"bc": COMMENT_END, "d3": SPAN_D3}, {"bc": "/*", "d3": '"""'}),
    "json": spec([PLAIN2, r"(?P<bad>\")"], {}, {}),
    "toml": spec(
        [HASH, r"(?P<d3>\"\"\")", r"(?P<s3>''')", PLAIN2, r"(?P<ok1>'[^'\n]*+')", UNCLOSED],
        {"d3": SPAN_D3, "s3": r"[\s\S]*?'''"},
        {"d3": '"""', "s3": "'''"},
    ),
}

Node = list
"""[unmatched closers, {opener taken off: next node} or None, openers left, end state, fault]; a node forks or ends."""
Summary = tuple[dict[str, int], list[Node]]
"""(start state -> node, nodes)."""


def _read(text: str, lang: Spec, at: int, state: str, last: int) -> tuple[Node, int]:
    """Read from ``at`` with no bracket open; the node, its fork unfilled, and the place behind its fork."""
    closers: list[str] = []
    stack: list[str] = []

    def left(end: str, why: str = "") -> tuple[Node, int]:
        return ["".join(closers), None, "".join(stack), end, why], len(text)

    templates, nested = "tpl" in lang.inside, "r0" in lang.inside
    while True:
        if state != "code":
            if state == "tpl" and at > last:
                return left(state)
            m = lang.inside[state].match(text, at)
            if m is None:
                return left(state)
            kind, at = m.lastgroup, m.end()
            if kind == "more":
                return left(state)
            if kind == "bad":
                return left("code", "string not closed on its line")
            if kind in ("hole", "inner"):
                stack.append("$" if kind == "hole" else "C")
                state = "code" if kind == "hole" else "bc"
                continue
            if kind == "tick":
                if not stack:
                    closers.append("`")
                elif stack.pop() != "`":
                    return left("code", "template closes another bracket")
            elif kind == "end":
                if not stack:
                    return ["".join(closers) + "c", {"c": 0, "C": 0}, "", "", ""], at
                state = AFTER.get(stack.pop(), "code")
                continue
            state = "code"
        search = lang.code.scanner(text, at).search
        while m := search():
            kind = m.lastgroup
            if kind == "b":
                c = m.group()
                if c in "([{":
                    stack.append(c)
                elif stack:
                    o = stack.pop()
                    if o not in CLOSES[c]:
                        return left("code", f"{c} closes another bracket")
                    if o == "$":
                        state, at = "tpl", m.end()
                        break
                elif templates and c == "}":
                    return ["".join(closers) + c, {"{": 0, "$": 0}, "", "", ""], m.end()
                else:
                    closers.append(c)
            elif kind in ("skip", "ok1", "ok2"):
                continue
            elif kind == "slash":
                if end := _regex_end(text, m.start()):
                    search = lang.code.scanner(text, end).search
            elif kind in ("bad", "bad1", "bad2"):
                return left("code", "string not closed on its line")
            else:
                if kind == "tpl":
                    stack.append("`")
                elif kind == "bc" and nested:
                    stack.append("c")
                elif kind == "hashed":
                    kind = f"r{m.group().count('#')}"
                    if kind not in lang.inside:
                        return left("code", "raw string of more than eight signs")
                state, at = kind, m.end()
                break
        else:
            return left("code")


def summary(text: str, ext: str, starts: list[str] | None = None) -> Summary:
    """The summary of a chunk from the given start states (all of the language's if None)."""
    lang = SPECS[ext]
    last = max(text.rfind("`"), text.rfind("${")) if "tpl" in lang.inside else -1
    nodes: list[Node] = []
    known: dict[tuple[int, str], int] = {}
    todo: list[tuple[int, str]] = []

    def place(at: int, state: str) -> int:
        got = known.get((at, state))
        if got is None:
            got = known[at, state] = len(nodes)
            nodes.append([])
            todo.append((at, state))
        return got

    first = {s: place(0, s) for s in (["code", *lang.inside] if starts is None else starts)}
    while todo:
        at, state = todo.pop()
        node, behind = _read(text, lang, at, state, last)
        if node[1] is not None:
            node[1] = {o: place(behind, AFTER.get(o, "code")) for o in node[1]}
        nodes[known[at, state]] = node
    return first, nodes


def combine(a: Summary, b: Summary) -> Summary:
    """The summary of two neighbouring chunks; associative."""
    starts, right = b
    nodes: list[Node] = []
    tails: dict[int, int] = {}
    todo: list[tuple[int, int]] = []

    def tail(k: int) -> int:
        """The copy of a node of b."""
        if k not in tails:
            tails[k] = len(nodes)
            nodes.append([])
            todo.append((k, tails[k]))
        return tails[k]

    for node in a[1]:
        nodes.append(list(node))
    for node in nodes[: len(a[1])]:
        if node[1] is not None or node[4]:
            continue
        closers, _, stack, end, _ = node
        if end not in starts:
            node[3], node[4] = end, "unknown state"
            continue
        own, taken = list(stack), []
        k = starts[end]
        while True:
            c2, fork, o2, end2, bad = right[k]
            o, wrong = "", ""
            for c in c2:
                if not own:
                    taken.append(c)
                    o = ""
                    continue
                o = own.pop()
                if o not in CLOSES[c]:
                    wrong = f"{'*/' if c == 'c' else c} closes another bracket"
                    break
            if wrong:
                node[:] = [closers + "".join(taken), None, "".join(own), "code", wrong]
            elif fork is None:
                node[:] = [closers + "".join(taken), None, "".join(own) + o2, end2, bad]
            elif o:
                k = fork[o]
                continue
            else:
                node[:] = [closers + "".join(taken), {x: tail(n) for x, n in fork.items()}, "", "", ""]
            break
    while todo:
        k, at = todo.pop()
        c2, fork, o2, end2, bad = right[k]
        nodes[at] = [c2, None if fork is None else {x: tail(n) for x, n in fork.items()}, o2, end2, bad]
    return a[0], nodes


def fault(total: Summary) -> str | None:
    """What the whole file's summary says against it, or None."""
    closers, fork, openers, end, bad = total[1][total[0]["code"]]
    if closers:
        return f"{closers[0]} closes nothing"
    if bad:
        return bad
    if end in ("s1", "s2"):
        return "string not closed on its line"
    if end != "code" or fork is not None:
        return "string or comment not closed"
    return f"{openers[-1]} not closed" if openers else None


def pieces(text: str, size: int, ext: str) -> list[tuple[str, list[str]]]:
    """(part, start states) of runs of whole lines of about ``size`` characters; a longer line is a part of its own.

    A state is left out where its opener stands nowhere before the part, so it cannot hold there.
    """
    opens = {s: text.find(o) for s, o in SPECS[ext].opens.items()}
    lined = [s for s in ("s1", "s2") if s in SPECS[ext].inside]
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", min(len(text), at + size - 1)) + 1 or len(text)
        continued = lined if text.endswith(("\\\n", "\\\r\n"), 0, at) else []
        out.append((text[at:end], ["code", *(s for s, p in opens.items() if 0 <= p < at), *continued]))
        at = end
    return out or [("", ["code"])]


def fold(parts: list[Summary]) -> Summary:
    total = parts[0]
    for p in parts[1:]:
        total = combine(total, p)
    return total


def whole(text: str, ext: str, size: int) -> Summary:
    """The summary of a text by way of its parts."""
    return fold([summary(p, ext, s) for p, s in pieces(text, size, ext)])
