"""Joins in which a few keys may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that hold one in so many rows of a join, of which there are no more than that, are broadcast.
HOT = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, whose keys are unique and have no nulls; right's column ``rows`` counts left's rows of a key.

    Rows of frequent keys meet theirs where they are and aren't shuffled.  left is read
    twice, so it should be a written table; ``rows`` isn't in the result.
    """
    most = max(1, total // HOT)
    few = right.filter(F.col(rows) > most).drop(rows)
    many = right.filter(F.col(rows) <= most).drop(rows)
    same = reduce(Column.__and__, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in on])
    hot = left.join(F.broadcast(few), on)
    rest = left.alias("l").join(F.broadcast(few.select(*on)).alias("r"), same, "left_anti")
    return hot.unionByName(rest.join(many, on, how))
