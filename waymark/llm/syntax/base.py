"""What the hand-written grammars share: tokens and a cursor over them."""

from __future__ import annotations


class Bad(Exception):
    """The text is not valid; args are (line, reason)."""


class Tok:
    __slots__ = ("kind", "value", "line", "nl")

    def __init__(self, kind: str, value: object, line: int, nl: bool) -> None:
        self.kind, self.value, self.line, self.nl = kind, value, line, nl


class Cursor:
    """Tokens with one end token behind them."""

    def __init__(self, toks: list[Tok]) -> None:
        self.t, self.i = toks, 0
        self.pairs: dict[int, int] | None = None

    @property
    def cur(self) -> Tok:
        return self.t[self.i]

    def peek(self, k: int = 1) -> Tok:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def closing(self, at: int) -> int:
        """The place of the ) that closes the ( at a place, or of the end token."""
        if self.pairs is None:
            self.pairs, stack = {}, []
            for k, c in enumerate(self.t):
                if c.kind == "op" and c.value == "(":
                    stack.append(k)
                elif c.kind == "op" and c.value == ")" and stack:
                    self.pairs[stack.pop()] = k
        return self.pairs.get(at, len(self.t) - 1)

    def fail(self, why: str = "unexpected") -> None:
        c = self.cur
        raise Bad(c.line, f"{why}: {str(c.value)[:30]!r}")

    def next(self) -> Tok:
        c = self.t[self.i]
        if c.kind != "eof":
            self.i += 1
        return c

    def at(self, *values: str) -> bool:
        c = self.t[self.i]
        return c.kind in ("op", "id") and c.value in values

    def op(self, *values: str) -> bool:
        c = self.t[self.i]
        return c.kind == "op" and c.value in values

    def eat(self, *values: str) -> bool:
        c = self.t[self.i]
        if c.kind in ("op", "id") and c.value in values:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> Tok:
        c = self.t[self.i]
        if c.kind not in ("op", "id") or c.value != value:
            self.fail(f"expected {value}")
        self.i += 1
        return c

    def split(self, value: str) -> bool:
        """Take ``value`` off the front of a longer sign, as > off >>."""
        c = self.t[self.i]
        if c.kind == "op" and isinstance(c.value, str) and c.value.startswith(value):
            if c.value == value:
                self.i += 1
            else:
                self.t[self.i] = Tok("op", c.value[len(value) :], c.line, False)
            return True
        return False
