"""Codesets: eight bits for what a read or a reference can show at a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A, C, G, T, GAP, PAD, CLIP, SKIP = (1 << i for i in range(8))
BASES, ANY = 15, 255
#: The IUPAC letters by the bits of their bases.
IUPAC = "?ACMGRSVTWYHKDBN"
#: Symbols of the other codes; the first of each is written alone, SKIP as J in a group.
OTHERS = {GAP: ".-Z", PAD: "_X", CLIP: ":L", SKIP: ",J"}


def code_of(symbol: str) -> int:
    """The codeset of one symbol, in either case."""
    s = symbol.upper()
    if s == "~":
        return ANY
    if s == "U":
        return T
    if s in IUPAC[1:]:
        return IUPAC.index(s)
    for code, symbols in OTHERS.items():
        if s in symbols:
            return code
    raise ValueError(f"unknown code {symbol!r}")


def codeset(text: str) -> int:
    """The union of symbols, with or without braces; 0 is the empty set."""
    inner = text.strip("{}")
    if not text:
        raise ValueError("no code")
    return 0 if inner in ("", "0") else sum_of(code_of(s) for s in inner if s != "0")


def sum_of(codes) -> int:
    out = 0
    for c in codes:
        out |= c
    return out


def name_of(code: int) -> str:
    if code in (0, ANY):
        return "~" if code else "0"
    parts = [IUPAC[code & BASES]] if code & BASES else []
    parts += [symbols[0] for bit, symbols in OTHERS.items() if code & bit]
    if len(parts) == 1:
        return parts[0]
    return "{" + "".join(parts).replace(",", "J") + "}"


def char_of(code: int) -> str:
    """One character; mixtures of kinds are a star."""
    name = name_of(code)
    if code == ANY or name.startswith("{"):
        return "*"
    return {GAP: "Z", PAD: "X", CLIP: "L", SKIP: "J"}.get(code, name)


def complement(code: int) -> int:
    swapped = (code & A) << 3 | (code & T) >> 3 | (code & C) << 1 | (code & G) >> 1
    return swapped | code & ~BASES


def subset(observed: int, allowed: int) -> bool:
    return observed & ~allowed == 0


def _literal(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def codes(text: Column) -> Column:
    """An array with the code of each letter of a sequence; null for what isn't one."""
    known = [None] * 128
    for letter in IUPAC[1:] + "U":
        known[ord(letter)] = known[ord(letter.lower())] = code_of(letter)
    known[ord("=")] = None
    table = F.array(*(F.lit(v).cast("int") for v in known))
    return F.transform(F.split(text, ""), lambda c: F.get(table, F.ascii(c)))


def complemented(code: Column) -> Column:
    return F.get(_literal([complement(c) for c in range(256)]), code)


def named(code: Column) -> Column:
    return F.get(_literal([name_of(c) for c in range(256)]), code)
