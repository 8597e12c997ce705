"""Strand rules: which strand a record reports on, and which way it is aligned.

A rule has two tables of conditions over FLAG bits and tags.  Exactly one key of each
must hold for a record; the key ``unknown`` of the first table sets a record aside.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.operators.boolean import Node, parse

#: The FLAG bits of the SAM format.
FLAGS = {
    "is_paired": 0x1, "is_proper_pair": 0x2, "is_unmapped": 0x4, "is_mate_unmapped": 0x8, "is_reverse": 0x10, "is_mate_reverse": 0x20,
    "is_first_in_template": 0x40, "is_last_in_template": 0x80, "is_secondary": 0x100, "is_quality_check_failed": 0x200, "is_duplicate": 0x400, "is_supplementary": 0x800,
}
ORIGINAL, ALIGNED = ("forward", "reverse", "unknown"), ("forward", "reverse")
#: Strand of origin by (original, aligned).
ORIGIN = {("forward", "forward"): "OT", ("forward", "reverse"): "CTOT", ("reverse", "reverse"): "OB", ("reverse", "forward"): "CTOB"}


def _leaf(rest: list[str]) -> Node:
    word = rest.pop(0)
    low = word.lower()
    if rest[:1] == ["=="]:
        if len(rest) < 2:
            raise ValueError(f"{word} == lacks a value")
        rest.pop(0)
        _check(word, rest[0])
        return Node("leaf", ("compare", word, rest.pop(0)))
    if low in ("true", "false"):
        return Node("const", low == "true")
    if low not in FLAGS:
        raise ValueError(f"no flag named {word!r}; there are {', '.join(FLAGS)}")
    return Node("leaf", ("flag", low))


def _check(name: str, value: str) -> None:
    tag, _, kind = name.partition(":")
    whole = name.lower() == "flags" or kind == "i"
    if name.lower() != "flags" and (len(tag) != 2 or kind not in ("", "i", "Z", "A")):
        raise ValueError(f"{name!r} isn't a tag")
    if whole:
        int(value, 0)
    elif not value.startswith('"'):
        raise ValueError(f"{name} is text: write its value in double quotes")


def _comparison(name: str, value: str, flags: Column, tags: Column) -> Column:
    """A tag that a record lacks compares false, whatever stands around the comparison."""
    if name.lower() == "flags":
        return flags == int(value, 0)
    tag, _, kind = name.partition(":")
    got = F.try_element_at(tags, F.lit(tag))
    if kind == "i":
        return F.coalesce(got["value"].try_cast("bigint") == int(value), F.lit(False))
    return F.coalesce(got["value"] == value[1:-1], F.lit(False))


@dataclass(frozen=True)
class StrandRule:
    original: dict[str, Node]
    aligned: dict[str, Node]

    @classmethod
    def parse(cls, text: str) -> StrandRule:
        return cls.of(tomllib.loads(text).get("strand", {}))

    @classmethod
    def of(cls, tables: dict) -> StrandRule:
        out = {}
        for side, keys in (("original", ORIGINAL), ("aligned", ALIGNED)):
            table = tables.get(side)
            if not table:
                raise ValueError(f"a strand rule has the table strand.{side}")
            if set(table) - set(keys):
                raise ValueError(f"strand.{side}: no key {sorted(set(table) - set(keys))}; there are {', '.join(keys)}")
            if len(set(table.values())) < len(table):
                raise ValueError(f"strand.{side}: two keys have the same condition")
            out[side] = {k: parse(v, _leaf, any_case=True) for k, v in table.items()}
        if set(tables) - {"original", "aligned"}:
            raise ValueError(f"strand: no table {sorted(set(tables) - {'original', 'aligned'})}")
        return cls(**out)

    def _called(self, table: dict[str, Node], side: str, flags: Column, tags: Column, qname: Column) -> Column:
        def leaf(x):
            return (flags.bitwiseAND(F.lit(FLAGS[x[1]])) != 0) if x[0] == "flag" else _comparison(x[1], x[2], flags, tags)

        held = {k: n.build(leaf, lambda v: F.lit(bool(v))) for k, n in table.items()}
        count = reduce(lambda a, b: a + b, (c.cast("int") for c in held.values()))
        call = F.lit(None).cast("string")
        for k, c in held.items():
            call = F.when(c, F.lit(k)).otherwise(call)
        wrong = F.raise_error(F.concat(F.lit(f"strand.{side}: "), count.cast("string"), F.lit(" keys hold for read "), qname))
        return F.when(count == 1, call).otherwise(wrong.cast("string"))

    def call(self, reads: DataFrame, flags: str = "flags", tags: str = "tags", qname: str = "qname") -> DataFrame:
        """Adds original, aligned (null where unknown), conv_strand, strand, walk_reversed and mirrors_read."""
        f, t, q = F.col(flags), F.col(tags), F.col(qname)
        out = reads.withColumn("original", self._called(self.original, "original", f, t, q))
        out = out.withColumn("aligned", F.when(F.col("original") == "unknown", F.lit(None)).otherwise(self._called(self.aligned, "aligned", f, t, q)))
        origin = F.lit(None).cast("string")
        for (o, a), name in ORIGIN.items():
            origin = F.when((F.col("original") == o) & (F.col("aligned") == a), F.lit(name)).otherwise(origin)
        is_back = F.col("original") == "reverse"
        return out.withColumns({
            "conv_strand": origin,
            "strand": F.when(F.col("aligned").isNotNull(), F.when(is_back, "-").otherwise("+")),
            "walk_reversed": F.when(F.col("aligned").isNotNull(), is_back),
            "mirrors_read": F.col("original") != F.col("aligned"),
        })


def _shared(original: dict, aligned: dict | None = None) -> dict:
    return {"original": original, "aligned": aligned or {"forward": "not is_reverse", "reverse": "is_reverse"}}


#: How aligners and callers record the strand.
RULES = {
    "astair": _shared({"forward": "flags == 99 or flags == 147 or flags == 0", "reverse": "flags == 83 or flags == 163 or flags == 16", "unknown": "not (flags == 99 or flags == 147 or flags == 0 or flags == 83 or flags == 163 or flags == 16)"}),
    "biscuit": _shared({"forward": 'YD == "f"', "reverse": 'YD == "r"', "unknown": 'YD == "u"'}),
    "bismark": _shared({"forward": 'XG == "CT"', "reverse": 'XG == "GA"'}, {"forward": '(XR == "CT" and XG == "CT") or (XR == "GA" and XG == "GA")', "reverse": '(XR == "GA" and XG == "CT") or (XR == "CT" and XG == "GA")'}),
    "bs-seeker2-se": _shared({"forward": 'XO == "+FW" or XO == "+RC"', "reverse": 'XO == "-FW" or XO == "-RC"'}, {"forward": 'XO == "+FW" or XO == "-RC"', "reverse": 'XO == "+RC" or XO == "-FW"'}),
    "bsbolt": _shared({"forward": 'YS == "W_C2T" or YS == "W_G2A"', "reverse": 'YS == "C_C2T" or YS == "C_G2A"', "unknown": 'YS == "WC"'}, {"forward": 'YS == "W_C2T" or YS == "C_G2A"', "reverse": 'YS == "W_G2A" or YS == "C_C2T"'}),
    "bsmap": _shared({"forward": 'ZS == "++" or ZS == "+-"', "reverse": 'ZS == "-+" or ZS == "--"'}, {"forward": 'ZS == "++" or ZS == "--"', "reverse": 'ZS == "+-" or ZS == "-+"'}),
    "bwameth": _shared({"forward": 'YD == "f"', "reverse": 'YD == "r"'}),
    "directional": _shared({"forward": "(not is_reverse and not is_last_in_template) or (is_reverse and is_last_in_template)", "reverse": "(is_reverse and not is_last_in_template) or (not is_reverse and is_last_in_template)"}),
    "dnmtools": _shared({"forward": '(CV == "T" and not is_reverse) or (CV == "A" and is_reverse)', "reverse": '(CV == "T" and is_reverse) or (CV == "A" and not is_reverse)'}),
    "hisat-3n": _shared({"forward": 'YZ == "+"', "reverse": 'YZ == "-"'}),
    "merantk": _shared({"forward": 'YG == "C2T"', "reverse": 'YG == "G2A"'}, {"forward": '(YG == "C2T" and YR == "C2T") or (YG == "G2A" and YR == "G2A")', "reverse": '(YG == "C2T" and YR == "G2A") or (YG == "G2A" and YR == "C2T")'}),
    "unconverted": _shared({"forward": "true"}),
}


def rule(name: str) -> StrandRule:
    if name not in RULES:
        raise KeyError(f"no strand rule named {name!r}; there are {', '.join(RULES)}")
    return StrandRule.of(RULES[name])
