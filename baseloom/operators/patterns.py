"""The query language: patterns over aligned columns, and boolean queries over patterns.

A file has the tables ``alias`` (one lowercase letter for a codeset), ``pattern``
(two rows of equal width), ``query`` (an expression over patterns, or rows of its own,
and a row of marks), ``tag`` and ``strand``.  Compiling rejects what can't work.
"""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, field
from itertools import product

from baseloom.functions import codes as K
from baseloom.operators.boolean import Node, parse

RELATION = {"=": "same", "/": "different"}


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class PatternColumn:
    read: int
    refr: int
    #: None, "same" or "different"
    relation: str | None = None

    def matches(self, read: int, refr: int) -> bool:
        if self.relation:
            single = read in (1, 2, 4, 8) and refr in (1, 2, 4, 8)
            if not single or (read == refr) != (self.relation == "same"):
                return False
        return K.subset(read, self.read) and K.subset(refr, self.refr)

    @property
    def dead(self) -> bool:
        """Nothing can match: a set is empty, or no two bases fit the relation."""
        if not self.read or not self.refr:
            return True
        return bool(self.relation) and not any(self.matches(a, b) for a, b in product((1, 2, 4, 8), repeat=2))

    @property
    def free(self) -> bool:
        return not self.relation and self.read == self.refr == K.ANY


Pattern = tuple[PatternColumn, ...]


@dataclass(frozen=True)
class Query:
    name: str
    expression: Node
    #: The patterns of the expression, by name.
    patterns: dict[str, Pattern]
    anchor: int
    captures: tuple[int, ...]
    span: int

    @property
    def flat(self) -> bool:
        return self.captures == (self.anchor,)

    def matches(self, read: list[int], refr: list[int], at: int) -> bool:
        """On plain lists, for explanations and tests."""
        return self.expression.holds(lambda name: all(c.matches(read[at + j], refr[at + j]) for j, c in enumerate(self.patterns[name])))

    def anchor_sets(self) -> list[tuple[int, int]]:
        """(read, refr) codesets that the anchor may show, over the ways to make the expression true."""
        names = list(dict.fromkeys(self.expression.leaves()))
        if len(names) > 20:
            return [(K.ANY, K.ANY)]
        out = []
        for bits in product((False, True), repeat=len(names)):
            truth = dict(zip(names, bits, strict=True))
            if self.expression.holds(truth.__getitem__):
                read = refr = K.ANY
                for n, b in truth.items():
                    if b:
                        c = self.patterns[n][self.anchor]
                        read, refr = read & c.read, refr & c.refr
                out.append((read, refr))
        return out

    @property
    def anchor_can_lack_base(self) -> bool:
        return any(read & ~K.BASES for read, _ in self.anchor_sets())

    @property
    def anchor_refr(self) -> str | None:
        """The one reference code that the anchor stands on, or None if there are several."""
        found = {refr for _, refr in self.anchor_sets()}
        only = found.pop() if len(found) == 1 else 0
        return K.name_of(only) if only in (1, 2, 4, 8) else None


@dataclass
class QueryFile:
    aliases: dict[str, int] = field(default_factory=dict)
    patterns: dict[str, Pattern] = field(default_factory=dict)
    queries: dict[str, Query] = field(default_factory=dict)
    tags: dict[str, dict] = field(default_factory=dict)
    strand: dict | None = None

    @property
    def max_span(self) -> int:
        return max((q.span for q in self.queries.values()), default=0)

    @property
    def flat(self) -> bool:
        return all(q.flat for q in self.queries.values())


def parse_row(text: str, aliases: dict[str, int]) -> list[tuple[int, str | None]]:
    """(codeset, relation) of each column of a row."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "{":
            close = text.find("}", i)
            body = text[i + 1 : close]
            if close < 0 or not body:
                raise QueryError(f"{text!r}: a group isn't closed or is empty")
            if "{" in body or "," in body:
                raise QueryError(f"{text!r}: no group in a group, and no comma in one (a skip is J there)")
            out.append((_set(body, text), None))
            i = close
        elif c in RELATION:
            out.append((K.BASES | K.GAP | K.PAD, RELATION[c]))
        elif c in aliases:
            out.append((aliases[c], None))
        elif c.isdigit():
            raise QueryError(f"{text!r}: rows have no repeat counts")
        elif c.islower() or c.isspace() or c == "}":
            raise QueryError(f"{text!r}: {c!r} isn't a code (base codes are uppercase)")
        else:
            out.append((_set(c, text), None))
        i += 1
    if not out:
        raise QueryError("an empty row")
    return out


def repeated(text: str) -> str:
    """A row with its repeat counts written out: ``~3`` is ``~~~``."""
    out, i = "", 0
    while i < len(text):
        close = text.find("}", i) if text[i] == "{" else i
        unit = text[i : max(close, i) + 1]
        i += len(unit)
        j = i
        while j < len(text) and text[j].isdigit():
            j += 1
        if unit.isdigit() or text[i:j].startswith("0"):
            raise QueryError(f"{text!r}: a count of one at least follows a code")
        out, i = out + unit * int(text[i:j] or 1), j
    return out


def _set(body: str, text: str) -> int:
    try:
        got = K.codeset(body)
    except ValueError as e:
        raise QueryError(f"{text!r}: {e}") from None
    if not got:
        raise QueryError(f"{text!r}: the empty set")
    return got


def parse_pattern(read: str, refr: str, aliases: dict[str, int] | None = None) -> Pattern:
    a, b = parse_row(read, aliases or {}), parse_row(refr, aliases or {})
    if len(a) != len(b):
        raise QueryError(f"rows of {len(a)} and {len(b)} columns: {read!r}, {refr!r}")
    out = []
    for (rs, rr), (fs, fr) in zip(a, b, strict=True):
        if rr and fr and rr != fr:
            raise QueryError(f"= against / in one column: {read!r}, {refr!r}")
        column = PatternColumn(rs, fs, rr or fr)
        if column.dead:
            raise QueryError(f"nothing can match a column of {read!r}, {refr!r}")
        if column.relation and (rs | fs) & ~(K.BASES | K.GAP | K.PAD):
            warnings.warn(f"part of a set beside = or / can't be reached: {read!r}, {refr!r}", stacklevel=2)
        out.append(column)
    return tuple(out)


def parse_marks(text: str) -> tuple[int, tuple[int, ...], int]:
    """(anchor, captures, width): + is the anchor, ^ a capture, . neither."""
    if set(text) - set(".+^"):
        raise QueryError(f"marks are ., + and ^: {text!r}")
    if text.count("+") > 1:
        raise QueryError(f"one anchor at most: {text!r}")
    anchor = max(text.find("+"), 0)
    return anchor, tuple(sorted({anchor, *(i for i, c in enumerate(text) if c == "^")})), len(text)


def _expression(text: str, patterns: dict[str, Pattern]) -> Node:
    def leaf(rest: list[str]) -> Node:
        word = rest.pop(0)
        if word not in patterns:
            raise QueryError(f"no pattern named {word!r}")
        return Node("leaf", word)

    try:
        return parse(text, leaf)
    except QueryError:
        raise
    except ValueError as e:
        raise QueryError(str(e)) from None


KEYS = {"alias", "pattern", "query", "tag", "strand"}


def load(*texts: str) -> QueryFile:
    """Query files as one set; order is kept, and a name may mean one thing only."""
    out, raws = QueryFile(), [tomllib.loads(t) for t in texts]
    for raw in raws:
        if set(raw) - KEYS:
            raise QueryError(f"unknown tables {sorted(set(raw) - KEYS)}")
        for letter, text in raw.get("alias", {}).items():
            if len(letter) != 1 or not letter.islower():
                raise QueryError(f"an alias is one lowercase letter, not {letter!r}")
            if out.aliases.setdefault(letter, _set(text.strip("{}"), text)) != _set(text.strip("{}"), text):
                raise QueryError(f"alias {letter!r} means two things")
        if "strand" in raw:
            if out.strand is not None:
                raise QueryError("two strand rules")
            out.strand = raw["strand"]
        for name, table in raw.get("tag", {}).items():
            if name in out.tags:
                raise QueryError(f"tag {name!r} is declared twice")
            out.tags[name] = table
    for raw in raws:
        own = {n: (t, {"read", "refr"}) for n, t in raw.get("pattern", {}).items()}
        own |= {n: (t, {"read", "refr", "where", "mark"}) for n, t in raw.get("query", {}).items() if "read" in t or "refr" in t}
        for name, (table, allowed) in own.items():
            if set(table) - allowed or not {"read", "refr"} <= set(table):
                raise QueryError(f"{name}: a pattern has read and refr, and nothing but {sorted(allowed)}")
            got = parse_pattern(table["read"], table["refr"], out.aliases)
            if out.patterns.setdefault(name, got) != got:
                raise QueryError(f"pattern {name!r} means two things")
    for raw in raws:
        only = [n for n in (*raw.get("pattern", {}), *(n for n, t in raw.get("query", {}).items() if "read" in t))]
        for name, table in raw.get("query", {}).items():
            if set(table) - {"read", "refr", "where", "mark"}:
                raise QueryError(f"query {name}: unknown keys {sorted(set(table) - {'read', 'refr', 'where', 'mark'})}")
            if name in out.queries:
                raise QueryError(f"two queries named {name!r}")
            text = table.get("where", name if "read" in table else only[0] if len(only) == 1 else None)
            if text is None:
                raise QueryError(f"query {name}: where is needed unless the file has one pattern")
            out.queries[name] = compile_query(name, text, table.get("mark"), out.patterns)
    used = {n for q in out.queries.values() for n in q.patterns}
    for name in out.patterns:
        if out.queries and name not in used:
            warnings.warn(f"pattern {name!r} isn't used", stacklevel=2)
    return out


def compile_query(name: str, text: str, mark: str | None, patterns: dict[str, Pattern]) -> Query:
    expression = _expression(text, patterns)
    used = {n: patterns[n] for n in dict.fromkeys(expression.leaves())}
    spans = {len(p) for p in used.values()}
    if len(spans) != 1:
        raise QueryError(f"query {name}: patterns of different widths" if spans else f"query {name}: no pattern")
    span = spans.pop()
    if expression.holds(lambda _: False):
        raise QueryError(f"query {name}: holds where no pattern does")
    anchor, captures, width = parse_marks(mark) if mark else (0, (0,), span)
    if width != span:
        raise QueryError(f"query {name}: {width} marks for {span} columns")
    return Query(name, expression, used, anchor, captures, span)


#: Names of the context calls, and letters of the calls by following bases.
CONTEXT_CALLS = ("CpG_methylated", "CpG_unmethylated", "CHG_methylated", "CHG_unmethylated", "CHH_methylated", "CHH_unmethylated")
CALL_LETTERS = ("Z", "z", "X", "x", "H", "h", "U", "u")


def _declared(kind: str, name: str, **values: str) -> str:
    return "\n".join([f"[{kind}.{name}]", *(f'{k} = "{v}"' for k, v in values.items())])


def methyldackel() -> str:
    """Calls at reference cytosines by the reference's context alone; what isn't a G behind the C counts as H."""
    contexts = {"CpG": "g_first", "CHG": "g_second and not g_first", "CHH": "not g_second and not g_first"}
    out = [_declared("pattern", "g_first", read="~~~", refr="~G~"), _declared("pattern", "g_second", read="~~~", refr="~~G")]
    out += [_declared("pattern", state, read=f"{base}~~", refr="C~~") for state, base in (("methylated", "C"), ("unmethylated", "T"))]
    for call in CONTEXT_CALLS:
        context, state = call.split("_")
        out.append(_declared("query", call, where=f"{state} and {contexts[context]}"))
    return "\n".join(out)


def bismark(gaps: int = 4) -> str:
    """Calls by the bases that follow in the read, with up to so many deletions before each; for walks that emit insertions."""
    behind = {"Z": "G", "X": "HG", "H": "HH", "U": "~~"}
    out, ways = [_declared("alias", "", o="{N_}").replace("[alias.]", "[alias]")], {}
    for call, context in behind.items():
        for name, base in ((call, "C"), (call.lower(), "T")):
            for deleted in product(range(gaps + 1), repeat=len(context)):
                read, refr = base, "C"
                for n, base_behind in zip(deleted, context, strict=True):
                    read, refr = read + "." * n + "o", refr + "~" * n + base_behind
                width = 1 + 2 * (gaps + 1)
                ways.setdefault(name, []).append("_".join([name, *map(str, deleted)]))
                out.append(_declared("pattern", ways[name][-1], read=read.ljust(width, "~"), refr=refr.ljust(width, "~")))
    whole = {name: " or ".join(w) for name, w in ways.items()}
    for name in CALL_LETTERS:
        known = " or ".join(whole[x] for x in CALL_LETTERS if x.isupper() == name.isupper() and x not in "Uu")
        out.append(_declared("query", name, where=f"({whole[name]}) and not ({known})" if name in "Uu" else whole[name]))
    out.append(_declared("tag", "xm.bases", fill=".", **{x: x for x in CALL_LETTERS}))
    return "\n".join(out)
