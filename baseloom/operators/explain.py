"""What a query asks for and what a window answers, as text."""

from __future__ import annotations

from baseloom.functions import codes as K
from baseloom.operators.boolean import Node
from baseloom.operators.patterns import Pattern, PatternColumn, Query, QueryError, QueryFile, parse_marks, parse_pattern, repeated


def code_list() -> list[tuple[str, str, int]]:
    """(symbol, what it stands for, codeset) of every code."""
    kinds = {K.GAP: "gap", K.PAD: "off the read or contig", K.CLIP: "clipped base", K.SKIP: "intron"}
    letters = [(s, " or ".join(b for b in "ACGT" if K.code_of(s) & K.code_of(b)), K.code_of(s)) for s in K.IUPAC[1:]]
    return [*letters, *((symbols[0], kinds[code], code) for code, symbols in K.OTHERS.items()), ("~", "anything", K.ANY)]


def tree(node: Node, depth: int = 0) -> list[str]:
    """An expression, a line for each part."""
    word = str(node.value) if node.kind in ("leaf", "const") else node.kind if node.kind != "count" else f"{node.low} to {node.high if node.high is not None else len(node.parts)} of"
    return ["  " * depth + word, *(x for p in node.parts for x in tree(p, depth + 1))]


def _side(codes: list[int]) -> list[str]:
    return [K.name_of(c) for c in codes]


def grid(query: Query) -> list[str]:
    """The query's patterns, column under column, with its marks below."""
    relation = {"same": "=", "different": "/", None: ""}
    cells = [[name, side, *(relation[c.relation] if side == "read" and c.relation else K.name_of(getattr(c, side)) for c in p)] for name, p in query.patterns.items() for side in ("read", "refr")]
    marks = ["+" if i == query.anchor else "^" if i in query.captures else "." for i in range(query.span)]
    rows = [*cells, [query.name, "mark", *marks]]
    wide = [max(len(r[k]) for r in rows) for k in range(query.span + 2)]
    return ["  ".join(v.ljust(n) for v, n in zip(r, wide, strict=True)).rstrip() for r in rows]


def prose(query: Query) -> str:
    """A sentence about span, anchor and what the anchor may stand on."""
    on = f"on reference {query.anchor_refr}" if query.anchor_refr else "on several reference codes"
    lacks = "; its anchor may lack a base" if query.anchor_can_lack_base else ""
    extra = f", capturing columns {', '.join(map(str, query.captures))}" if not query.flat else ""
    return f"{query.name}: {query.span} columns, anchored at column {query.anchor} {on}{extra}{lacks}"


def explained(queries: QueryFile) -> str:
    return "\n\n".join("\n".join([prose(q), *grid(q), *tree(q.expression, 1)]) for q in queries.queries.values())


def columns_of_text(text: str) -> tuple[list[int], list[int]]:
    """Columns made up as ``READ@REFR``, to try a query on; repeat counts are allowed."""
    read, _, refr = text.partition("@")
    rows = [[K.codeset(s) for s in _symbols(repeated(x))] for x in (read, refr)]
    if len(rows[0]) != len(rows[1]) or not rows[0]:
        raise QueryError(f"{text!r}: as many columns for the read as for the reference, one at least")
    return rows[0], rows[1]


def _symbols(text: str) -> list[str]:
    out, i = [], 0
    while i < len(text):
        close = text.find("}", i) if text[i] == "{" else i
        if close < 0:
            raise QueryError(f"{text!r}: a group isn't closed")
        out.append(text[i : close + 1])
        i = close + 1
    return out


def _why(c: PatternColumn, read: int, refr: int) -> str:
    parts = []
    if not K.subset(read, c.read):
        parts.append(f"read {K.name_of(read)} isn't in {K.name_of(c.read)}")
    if not K.subset(refr, c.refr):
        parts.append(f"reference {K.name_of(refr)} isn't in {K.name_of(c.refr)}")
    if not parts and not c.matches(read, refr):
        parts.append(f"{K.name_of(read)} and {K.name_of(refr)} aren't {c.relation}")
    return " and ".join(parts)


def _tried(name: str, pattern: Pattern, read: list[int], refr: list[int], at: int) -> str:
    for j, c in enumerate(pattern):
        if why := _why(c, read[at + j], refr[at + j]):
            return f"  {name}: no, column {j}: {why}"
    return f"  {name}: yes"


def traced(queries: QueryFile, read: list[int], refr: list[int]) -> str:
    """For each query and window whether it holds, and why patterns don't."""
    out = [f"read {' '.join(_side(read))}", f"refr {' '.join(_side(refr))}"]
    for q in queries.queries.values():
        for at in range(len(read) - q.span + 1):
            out.append(f"{q.name} at {at}: {'hit' if q.matches(read, refr, at) else 'no hit'}")
            out += [_tried(n, p, read, refr, at) for n, p in q.patterns.items()]
    return "\n".join(out)


def terse(text: str, aliases: dict[str, int] | None = None) -> Pattern:
    """A pattern written ``read@refr``, in which a code may be followed by how often it comes; marks don't belong there."""
    read, at, refr = text.partition("@")
    if not at:
        raise QueryError(f"{text!r}: a read's row, @, and a reference's row")
    if set(text) & set("+^"):
        raise QueryError(f"{text!r}: marks go in a row of their own")
    return parse_pattern(repeated(read), repeated(refr), aliases)


def marked(text: str) -> tuple[int, tuple[int, ...], int]:
    """As parse_marks, with repeat counts."""
    return parse_marks(repeated(text))
