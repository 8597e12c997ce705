"""Small boolean languages: words, comparisons, parentheses, not before and before or."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

TOKEN = re.compile(r"""\s*(?:(?P<string>"[^"]*")|(?P<op>==|[()])|(?P<word>[^\s()"=]+))""")


@dataclass(frozen=True)
class Node:
    """kind: leaf, const, not, and, or, count."""

    kind: str
    value: object = None
    parts: tuple[Node, ...] = ()
    low: int = 0
    high: int | None = None

    def leaves(self) -> list:
        return [self.value] if self.kind == "leaf" else [x for p in self.parts for x in p.leaves()]

    def holds(self, truth: Callable[[object], bool]) -> bool:
        if self.kind == "leaf":
            return bool(truth(self.value))
        if self.kind == "const":
            return bool(self.value)
        got = [p.holds(truth) for p in self.parts]
        if self.kind == "count":
            return self.low <= sum(got) and (self.high is None or sum(got) <= self.high)
        return {"not": lambda: not got[0], "and": lambda: all(got), "or": lambda: any(got)}[self.kind]()

    def build(self, leaf: Callable, lit: Callable):
        """The same in another algebra: one with &, | and ~."""
        if self.kind == "leaf":
            return leaf(self.value)
        if self.kind == "const":
            return lit(self.value)
        parts = [p.build(leaf, lit) for p in self.parts]
        if self.kind == "count":
            total = sum(p.cast("int") for p in parts)
            return (total >= self.low) & (total <= self.high) if self.high is not None else total >= self.low
        out = parts[0]
        for p in parts[1:]:
            out = out & p if self.kind == "and" else out | p
        return ~out if self.kind == "not" else out


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        out.append(m.group(m.lastgroup))
        at = m.end()
    return out


def parse(text: str, leaf: Callable[[list[str]], Node], any_case: bool = False) -> Node:
    """leaf: takes tokens off the front of a list for one comparison or name."""
    rest = tokens(text)
    if not rest:
        raise ValueError("empty expression")

    def word() -> str | None:
        return (rest[0].lower() if any_case else rest[0]) if rest else None

    def joined(kind: str, below: Callable[[], Node]) -> Node:
        parts = [below()]
        while word() == kind:
            rest.pop(0)
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(kind, parts=tuple(parts))

    def unit() -> Node:
        w = word()
        if w is None:
            raise ValueError(f"{text!r} ends too early")
        if w == "not":
            rest.pop(0)
            return Node("not", parts=(unit(),))
        if w == "(":
            rest.pop(0)
            inner = whole()
            if not rest or rest.pop(0) != ")":
                raise ValueError(f"{text!r}: a parenthesis isn't closed")
            return inner
        if w in ("and", "or", ")", "=="):
            raise ValueError(f"{text!r}: {rest[0]!r} isn't expected here")
        return leaf(rest)

    def whole() -> Node:
        return joined("or", lambda: joined("and", unit))

    out = whole()
    if rest:
        raise ValueError(f"{text!r}: {rest[0]!r} isn't expected here")
    return out
