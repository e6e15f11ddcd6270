"""Local grammars by extension: valid(text, ext) gives None, or the reason a text is invalid."""

from __future__ import annotations

import json
import re
import sys
import warnings

from waymark.llm.syntax import chunks, ecma, golang, java, rust, yamlish
from waymark.llm.syntax.base import Bad

EXTENSIONS = ("py", "js", "ts", "go", "rs", "java", "json", "toml", "yaml")
CONTINUES = re.compile(r"(?:else|elif|except|finally)\b")
FRAMES = 60_000, 4_000_000
"""Python frames allowed to a grammar, at first and at most: frames lie on the heap, about 200 bytes each."""
TOO_DEEP = "nested deeper than any compiler reads"
JSON_TOKEN = re.compile(r'[ \t\n\r]*+(?:(?P<open>[\[{])|(?P<close>[\]}])|(?P<sep>[,:])|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<val>-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null))', re.ASCII)


def python_statements(text: str) -> list[tuple[int, str]]:
    """(first line, text) of top-level statements: a line at the margin, outside brackets and strings, starts one."""
    lang = chunks.SPECS["py"]
    starts, depth, state, at = [], 0, "code", 0
    inside: list[tuple[int, int]] = []  # spans where a line start is no statement start
    opened = 0
    while True:
        if state != "code":
            m = lang.inside[state].match(text, at)
            end = m.end() if m else len(text)
            inside.append((at, end))
            if m is None:
                break
            state, at = "code", end
        for m in lang.code.finditer(text, at):
            kind = m.lastgroup
            if kind == "b":
                if m.group() in "([{":
                    if not depth:
                        opened = m.start()
                    depth += 1
                elif depth:
                    depth -= 1
                    if not depth:
                        inside.append((opened, m.end()))
            elif kind in ("ok1", "ok2") and "\n" in m.group():
                inside.append(m.span())
            elif kind in lang.inside:
                state, at = kind, m.end()
                break
        else:
            break
    inside.sort()
    k, held = 0, False
    for m in re.compile(r"^(?=[^\s#])", re.MULTILINE).finditer(text):
        p = m.start()
        while k < len(inside) and inside[k][1] <= p:
            k += 1
        if k < len(inside) and inside[k][0] < p:
            continue
        if p and re.compile(r"\\\r?\n$").search(text, max(0, p - 3), p):
            continue
        if CONTINUES.match(text, p) or held:
            held = text[p] == "@"
            continue
        starts.append(p)
        held = text[p] == "@"
    if not starts:
        return [(1, text)] if text.strip() else []
    starts[0] = 0
    out, line = [], 1
    for s, e in zip(starts, [*starts[1:], len(text)], strict=True):
        out.append((line, text[s:e]))
        line += text.count("\n", s, e)
    return out


def python(text: str) -> None:
    """Top-level statements by Python's own parser.

    It raises RecursionError only behind its grammar, which has then accepted the statement, and MemoryError
    where its own stack ends, so no interpreter reads the statement.
    """
    text = text[1:] if text.startswith("\ufeff") else text
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for line, part in python_statements(text.replace("\r\n", "\n").replace("\r", "\n")):
            try:
                compile(part, "<file>", "exec", dont_inherit=True)
            except (SyntaxError, ValueError) as e:
                raise Bad(line + (getattr(e, "lineno", None) or 1) - 1, str(getattr(e, "msg", None) or e)) from None
            except RecursionError:
                pass
            except MemoryError:
                raise Bad(line, TOO_DEEP) from None


def no_constant(x: str) -> None:
    raise ValueError(f"{x} is no JSON")


def json_text(text: str) -> None:
    try:
        json.loads(text, parse_constant=no_constant, parse_int=len, parse_float=len)
    except RecursionError:
        json_deep(text)
    except ValueError as e:
        raise Bad(getattr(e, "lineno", 1), getattr(e, "msg", str(e))) from None


def json_deep(text: str) -> None:
    """JSON of any depth, with a stack of its own."""
    stack: list[str] = []
    want, at = "value", 0  # value, value or ], key or }, key, colon, or end of a value
    while True:
        m = JSON_TOKEN.match(text, at)
        if m is None:
            if want == "end" and not stack and not text[at:].strip(" \t\n\r"):
                return
            break
        kind, c, at = m.lastgroup, m.group(m.lastgroup), m.end()
        if want in ("value", "value or ]"):
            if kind == "open":
                stack.append(c)
                want = "value or ]" if c == "[" else "key or }"
            elif kind in ("str", "val"):
                want = "end"
            elif c == "]" and want == "value or ]":
                stack.pop()
                want = "end"
            else:
                break
        elif want in ("key", "key or }"):
            if kind == "str":
                want = "colon"
            elif c == "}" and want == "key or }":
                stack.pop()
                want = "end"
            else:
                break
        elif want == "colon":
            if c != ":":
                break
            want = "value"
        elif c == "," and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif kind == "close" and stack and stack[-1] == ("[" if c == "]" else "{"):
            stack.pop()
        else:
            break
    raise Bad(text.count("\n", 0, at) + 1, f"expected {want}")


def toml(text: str) -> None:
    import tomllib

    try:
        tomllib.loads(text)
    except ValueError as e:
        at = re.search(r"at line (\d+)", str(e))
        raise Bad(int(at.group(1)) if at else text.count("\n") + 1, str(e)[:80]) from None


GRAMMARS = {"py": python, "js": lambda t: ecma.check(t, False), "ts": lambda t: ecma.check(t, True), "go": golang.check, "rs": rust.check, "java": java.check, "json": json_text, "toml": toml, "yaml": yamlish.check}


def parse(text: str, ext: str) -> tuple[int, str] | None:
    """None if the statements parse, else (line, reason)."""
    limit = sys.getrecursionlimit()
    for frames in FRAMES:
        sys.setrecursionlimit(max(limit, frames))
        try:
            GRAMMARS[ext](text)
            return None
        except Bad as e:
            return e.args[0], e.args[1]
        except RecursionError:
            continue
        finally:
            sys.setrecursionlimit(limit)
    return 1, TOO_DEEP
