"""Declarations: measures sort query names into categories, relations set categories against each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from baseloom.functions.columns import COMPARISONS, known


class DeclarationError(ValueError):
    pass


def _tuple(x) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


class Measure:
    """Query names in two or more disjoint categories."""

    def __init__(self, name: str, categories: dict | None = None, **more):
        self.name, self.categories = name, {}
        taken: set[str] = set()
        for category, names in {**(categories or {}), **more}.items():
            own = _tuple(names)
            if again := taken & set(own):
                raise DeclarationError(f"measure {name!r}: {', '.join(sorted(again))} again in {category!r}")
            taken |= set(own)
            self.categories[category] = own
        if not name or len(self.categories) < 2:
            raise DeclarationError(f"a measure has a name and two categories at least, not {name!r} and {list(self.categories)}")

    def __eq__(self, other):
        return isinstance(other, Measure) and (self.name, self.categories) == (other.name, other.categories)

    def __hash__(self):
        return hash(self.name)

    def _side(self, categories, rest: tuple[str, ...]) -> tuple[str, ...]:
        """Categories of the measure; rest where none are given."""
        side = rest if categories is None else _tuple(categories)
        for c in side:
            known(f"category of measure {self.name!r}", c, self.categories)
        return side

    def relate(self, main=None, other=None, *, name: str | None = None) -> Relation:
        """main against other; without other, against all the rest; without main, the only pair."""
        first, *rest = self.categories
        if main is None and len(rest) > 1:
            raise DeclarationError(f"measure {self.name!r} has {len(rest) + 1} categories: say which to relate")
        left = self._side(main, (first,))
        right = self._side(other if main is not None else None, tuple(c for c in self.categories if c not in left))
        if shared := set(left).intersection(right):
            raise DeclarationError(f"measure {self.name!r}: {', '.join(sorted(shared))} on both sides")
        # the only pair, in its order, goes by the measure's name
        usual = self.name if [*left, *right] == list(self.categories) and len(rest) == 1 else f"{self.name}.{'+'.join(left)}_vs_{'+'.join(right)}"
        return Relation(name or usual, self, left, right)

    def missing(self) -> Check:
        """Reads that have nothing of this measure."""
        return Check("missing", measure=self, levels=("read",))

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.relate(), name)


@dataclass(frozen=True)
class Relation:
    name: str
    measure: Measure
    main_side: tuple[str, ...]
    other_side: tuple[str, ...]

    def _quantity(self, name: str, *levels: str) -> Quantity:
        return Quantity(self, name, levels or ("read", "block", "site"))

    @property
    def main(self) -> Quantity:
        return self._quantity("main")

    @property
    def other(self) -> Quantity:
        return self._quantity("other")

    @property
    def total(self) -> Quantity:
        return self._quantity("total")

    @property
    def ratio(self) -> Quantity:
        return self._quantity("ratio")

    @property
    def consecutive(self) -> Quantity:
        """The longest run of main-side calls along a read."""
        return self._quantity("consecutive", "read")

    @property
    def reads(self) -> Quantity:
        """Distinct reads of a block."""
        return self._quantity("reads", "block")

    @property
    def sites(self) -> Quantity:
        """Distinct sites of a block."""
        return self._quantity("sites", "block")

    @property
    def blocks(self) -> Quantity:
        """Distinct blocks that cover a site's position."""
        return self._quantity("blocks", "site")


@dataclass(frozen=True)
class Quantity:
    relation: Relation
    name: str
    levels: tuple[str, ...]

    def _check(self, op: str, threshold) -> Check:
        known("comparison", op, COMPARISONS)
        if self.name == "total" and {"<": threshold <= 1, "<=": threshold < 1, "=": threshold < 1}.get(op, False):
            raise DeclarationError(f"total {op} {threshold} matches nothing: what has a row has a total of 1 at least; missing() finds the others")
        return Check(self.name, self.relation.measure, self.relation, op, threshold, self.levels)

    def gt(self, t):
        return self._check(">", t)

    def ge(self, t):
        return self._check(">=", t)

    def lt(self, t):
        return self._check("<", t)

    def le(self, t):
        return self._check("<=", t)

    def eq(self, t):
        return self._check("=", t)

    def ne(self, t):
        return self._check("<>", t)


@dataclass(frozen=True)
class Check:
    """A reason to throw something away: what meets it fails."""

    kind: str
    measure: Measure | None = None
    relation: Relation | None = None
    op: str | None = None
    threshold: object = None
    levels: tuple[str, ...] = ("read", "block", "site")
    parts: tuple = field(default=())
    argument: object = None

    @property
    def label(self) -> str:
        if self.kind == "both":
            return " and ".join(p.label for p in self.parts)
        named = self.relation or self.measure
        words = [named.name if named else "", self.kind, self.op or "", "" if self.threshold is None else str(self.threshold)]
        return " ".join(w for w in words if w)

    def at(self, level: str) -> Check:
        if level not in self.levels:
            raise DeclarationError(f"{self.label} is for {' or '.join(self.levels)}, not for a {level}")
        for p in self.parts:
            p.at(level)
        return self

    def declared(self) -> list:
        return [x for x in (self.measure, self.relation) if x] + [y for p in self.parts for y in p.declared()]


def both(*checks: Check) -> Check:
    """Fails what fails every part."""
    if len(checks) < 2:
        raise DeclarationError("both() joins two checks at least")
    levels = tuple(x for x in ("read", "block", "site") if all(x in c.levels for c in checks))
    return Check("both", levels=levels, parts=tuple(checks))


def at_position(check: Check) -> Check:
    """As check, over the evidence of all blocks and strands at a position."""
    if check.kind not in ("main", "other", "total", "ratio"):
        raise DeclarationError(f"{check.kind} isn't pooled by position")
    return Check("position", check.measure, check.relation, check.op, check.threshold, ("site",), argument=check.kind)


def in_regions(regions: DataFrame) -> Check:
    return Check("in_regions", levels=("site",), argument=regions)


def outside_regions(regions: DataFrame) -> Check:
    return Check("outside_regions", levels=("site",), argument=regions)


def listed(names: DataFrame) -> Check:
    """Reads whose qname is in a table of one column."""
    return Check("listed", levels=("read",), argument=names)


def fails(function, *levels: str) -> Check:
    """Whatever function(evidence) returns: a table of the level's keys."""
    return Check("custom", levels=levels or ("read", "block", "site"), argument=function)


def name_table(spark: SparkSession, measures) -> DataFrame:
    """(measure, name, category)."""
    rows = [(m.name, n, c) for m in measures for c, names in m.categories.items() for n in names]
    return spark.createDataFrame(rows, "measure string, name string, category string")


def side_table(spark: SparkSession, relations) -> DataFrame:
    """(measure, relation, name, main, side): for each name of a relation's measure, is it on the main side, and on either."""
    rows = []
    for r in relations:
        for c, names in r.measure.categories.items():
            main = int(c in r.main_side)
            rows += [(r.measure.name, r.name, n, main, int(main or c in r.other_side)) for n in names]
    return spark.createDataFrame(rows, "measure string, relation string, name string, main int, side int")
