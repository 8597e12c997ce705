"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baseloom.llm._hot import join_hot
from baseloom.llm._scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: (x, y).  Gives (node, comp), comp being the least node that can be reached.

    Labels pass to neighbours and then jump to the label of the label, so rounds grow
    with the logarithm of a chain's length.  Each round is written, which cuts lineage.
    Hubs, and labels that many nodes have, are broadcast instead of shuffled to.  Loops,
    repeated edges and edges both ways do no harm; nulls in edges are left out.
    """
    edges = edges.select("x", "y").filter("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = scratch.write(edges.union(edges.select("y", "x")).distinct())
    total = both.count()
    labels = scratch.write(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("comp"), F.count("*").alias("degree")))
    while total:
        near = labels.select(F.col("node").alias("y"), F.col("comp").alias("near"), "degree")
        told = join_hot(both, near, ["y"], "degree", total).groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        better = scratch.write(labels.join(told, "node").select("node", "degree", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        sizes = better.groupBy("comp").agg(F.count("*").alias("members"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far")).join(sizes, "comp")
        new = scratch.write(join_hot(better, jump, ["comp"], "members", total, "left").select("node", "degree", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")))
        scratch.drop(labels, better)
        labels = new
        if new.filter("comp <> old").isEmpty():
            break
        labels = new.select("node", "comp", "degree")
    return labels.select("node", "comp")
