"""Column expressions shared by the aggregation operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {
    "<": lambda x, t: x < t,
    "<=": lambda x, t: x <= t,
    ">": lambda x, t: x > t,
    ">=": lambda x, t: x >= t,
    "=": lambda x, t: x == t,
    "<>": lambda x, t: x != t,
}
QUANTITIES = {
    "main": lambda num, den: num.cast("double"),
    "other": lambda num, den: (den - num).cast("double"),
    "total": lambda num, den: den.cast("double"),
    "ratio": lambda num, den: num.cast("double") / F.when(den > 0, den),
}


def known(kind: str, name: str, table) -> str:
    """name, if the table has it; a misspelt one is an error before anything runs."""
    if name not in table:
        raise KeyError(f"no {kind} named {name!r}; known: {', '.join(sorted(table))}")
    return name


def compare(x: Column, op: str, threshold) -> Column:
    return COMPARISONS[known("comparison", op, COMPARISONS)](x, F.lit(threshold))


def quantity_value(name: str, num: Column, den: Column) -> Column:
    """main, other, total or ratio of two counts; a ratio of nothing is null."""
    return QUANTITIES[known("quantity", name, QUANTITIES)](num, den)


def pos0(pos: Column, base: int = 0) -> Column:
    """0-based position, from one counted from base."""
    return pos - F.lit(base)


def pos1(pos: Column, base: int = 0) -> Column:
    """1-based position, from one counted from base."""
    return pos + F.lit(1 - base)


def block_key(columns: str | list[str] | None, sep: str = ".") -> Column:
    """What partitions reads: 'bulk', an expression, or columns joined without their nulls."""
    if not columns:
        return F.lit("bulk")
    if isinstance(columns, str):
        return F.expr(columns)
    return F.col(columns[0]) if len(columns) == 1 else F.concat_ws(sep, *columns)
