"""Counts of hits by read, block and site, and the checks that judge them.

Declarations are a handful of rows and are broadcast; a hit is joined to the names of
its relations and summed in one aggregation, so a level costs one shuffle of partial
sums.  Sparse throughout: what has no hit has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baseloom.functions.columns import block_key, compare, known, pos0, quantity_value
from baseloom.operators.measures import Check, Measure, Relation, name_table, side_table

SITE = ["block", "contig", "refr_pos", "strand"]
KEYS = {"read": ["read"], "block": ["block"], "site": SITE}
READ = ("qname", "mate")
#: Regions are found by bins of so many positions, unless they are few enough to broadcast.
BIN = 1 << 9


def source(hits: DataFrame, read: tuple[str, ...] = READ, block=None, block_sep: str = ".", names: dict[str, str] | None = None) -> DataFrame:
    """Hits with ``read`` (a struct of columns), ``block``, and contig, refr_pos, strand, name.

    names: the hits' own names of those columns, if they differ.
    """
    out = hits
    for ours, theirs in (names or {}).items():
        out = out.withColumnRenamed(theirs, ours)
    return out.withColumn("read", F.struct(*read)).withColumn("block", block_key(block, block_sep))


def where(hits: DataFrame, *alternatives: str | Column) -> DataFrame:
    """Hits for which one of the conditions holds; calls are chained for conditions that must all hold."""
    if not alternatives:
        return hits
    return hits.filter(reduce(lambda a, b: a | b, (F.expr(c) if isinstance(c, str) else c for c in alternatives)))


class Evidence:
    """A source under declared measures and relations.

    ``hits`` are what blocks and reads are judged by; ``resolved`` what sites count.
    """

    def __init__(self, hits: DataFrame, measures: list[Measure], relations: list[Relation] | None = None, resolved: DataFrame | None = None, merge: Measure | None = None, span: int = 1, coordinate_base: int = 0):
        self.hits, self.resolved = hits, hits if resolved is None else resolved
        self.measures = {m.name: m for m in measures}
        self.relations = {r.name: r for r in (relations if relations is not None else [m.relate() for m in measures if len(m.categories) == 2])}
        self.merge, self.span, self.base = merge, span, coordinate_base
        spark = hits.sparkSession
        self._names = F.broadcast(name_table(spark, self.measures.values()))
        self._sides = F.broadcast(side_table(spark, self.relations.values()))

    def _relation(self, relation: Relation | str) -> Relation:
        return self.relations[known("relation", relation if isinstance(relation, str) else relation.name, self.relations)]

    # categories

    def read_category(self) -> DataFrame:
        return self.hits.join(self._names, "name").groupBy("read", "measure", "category").agg(F.count("*").alias("n"))

    def block_category(self) -> DataFrame:
        return self.hits.join(self._names, "name").groupBy("block", "measure", "category").agg(F.count("*").alias("n"))

    def site_stranded(self) -> DataFrame:
        return self.resolved.join(self._names, "name").groupBy(*SITE, "measure", "category").agg(F.count("*").alias("n"))

    def _folded(self, rows: DataFrame) -> DataFrame:
        """The merged measure's minus-strand rows, moved onto the plus strand."""
        if self.merge is None:
            return rows
        here = F.col("measure") == self.merge.name
        return rows.withColumns({
            "refr_pos": F.when(here & (F.col("strand") == "-"), F.col("refr_pos") - self.span).otherwise(F.col("refr_pos")),
            "strand": F.when(here, F.lit("+")).otherwise(F.col("strand")),
        })

    def site_category(self) -> DataFrame:
        return self._folded(self.resolved.join(self._names, "name")).groupBy(*SITE, "measure", "category").agg(F.count("*").alias("n"))

    # relations

    def _tally(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        sums = (F.sum(c).cast("bigint").alias(n) for c, n in (("main", "num"), ("side", "den")))
        return rows.groupBy(*keys, "relation").agg(*sums)

    def read_relation(self) -> DataFrame:
        return self._tally(self.hits.join(self._sides, "name"), ["read"])

    def block_relation(self) -> DataFrame:
        return self._tally(self.hits.join(self._sides, "name"), ["block"])

    def site_all(self) -> DataFrame:
        return self._tally(self._folded(self.resolved.join(self._sides, "name")), SITE)

    def block_extent(self) -> DataFrame:
        """Distinct reads and sites of each block and relation, of hits on either side."""
        rows = self.hits.join(self._sides, "name").filter("side = 1")
        return rows.groupBy("block", "relation").agg(F.count_distinct("read").alias("reads"), F.count_distinct(F.struct("contig", "refr_pos", "strand")).alias("sites"))

    # checks

    def _table(self, level: str) -> DataFrame:
        return {"read": self.read_relation, "block": self.block_relation, "site": self.site_all}[level]()

    def _row_test(self, check: Check) -> tuple[str, Column] | None:
        """(relation, condition) of a check that one row of a level's table decides; None for others."""
        if check.kind in ("main", "other", "total", "ratio"):
            known("measure", check.measure.name, self.measures)
            return self._relation(check.relation).name, compare(quantity_value(check.kind, F.col("num"), F.col("den")), check.op, check.threshold)
        if check.kind == "both":
            tests = [self._row_test(p) for p in check.parts]
            if None not in tests and len({name for name, _ in tests}) == 1:
                return tests[0][0], reduce(Column.__and__, (c for _, c in tests))
        return None

    def rejected(self, check: Check, level: str) -> DataFrame:
        """Rows of the level's keys that fail; one key may come several times."""
        check.at(level)
        if test := self._row_test(check):
            return self._table(level).filter((F.col("relation") == test[0]) & test[1]).select(*KEYS[level])
        if check.kind == "both":
            return reduce(lambda a, b: a.intersect(b), (self.rejected(p, level) for p in check.parts))
        if check.kind == "custom":
            return check.argument(self).select(*KEYS[level])
        if check.measure is not None:
            known("measure", check.measure.name, self.measures)
        return getattr(self, f"_fails_{check.kind}")(check)

    def counted(self, checks: list[Check], level: str) -> list[DataFrame | Column]:
        """How many rows each check rejects: a condition on a row of the level's table where that is enough, else a table of n."""
        out = []
        for check in checks:
            test = self._row_test(check.at(level))
            out.append((F.col("relation") == test[0]) & test[1] if test else self.rejected(check, level).agg(F.count("*").alias("n")))
        return out

    def _site_flag(self, check: Check) -> Column | None:
        """Whether a check rejects the site of a row of site_all, from windows over the sites; None if it takes a join."""
        site, spot = Window.partitionBy(*SITE), Window.partitionBy("contig", "refr_pos")
        if test := self._row_test(check):
            return F.max((F.col("relation") == test[0]) & test[1]).over(site)
        if check.kind == "both":
            flags = [self._site_flag(p) for p in check.parts]
            return None if any(f is None for f in flags) else reduce(Column.__and__, flags)
        if check.kind == "position":
            return self._position_fails(check, spot)
        if check.kind == "blocks":
            return F.max((F.col("relation") == self._relation(check.relation).name) & self._blocks_fail(check)).over(site)
        return None

    def _position_fails(self, check: Check, spot) -> Column:
        here = F.col("relation") == self._relation(check.relation).name
        num, den = (F.sum(F.when(here, F.col(c))).over(spot) for c in ("num", "den"))
        return F.coalesce(compare(quantity_value(check.argument, num, den), check.op, check.threshold), F.lit(False))

    def _blocks_fail(self, check: Check) -> Column:
        """Of a relation's rows; a block has one row at a site."""
        covers = (F.col("relation") == self._relation(check.relation).name) & (F.col("den") > 0) & F.col("block").isNotNull()
        return compare(F.sum(covers.cast("int")).over(Window.partitionBy("contig", "refr_pos", "strand")), check.op, check.threshold)

    def _failing(self, table: DataFrame, check: Check, value: Column, keys: list[str]) -> DataFrame:
        relation = self._relation(check.relation)
        return table.filter((F.col("relation") == relation.name) & compare(value, check.op, check.threshold)).select(*keys)

    def _fails_reads(self, check: Check) -> DataFrame:
        return self._failing(self.block_extent(), check, F.col("reads"), ["block"])

    def _fails_sites(self, check: Check) -> DataFrame:
        return self._failing(self.block_extent(), check, F.col("sites"), ["block"])

    def _fails_consecutive(self, check: Check) -> DataFrame:
        """Runs of main-side calls along each read: gaps and islands over distinct calls.

        Contigs and strands don't separate calls.  Where a position has both sides, the
        other side comes first.
        """
        relation = self._relation(check.relation)
        calls = self.hits.join(self._sides.filter(F.col("relation") == relation.name), "name").filter("side = 1").select("read", "refr_pos", "main").distinct()
        along = Window.partitionBy("read").orderBy("refr_pos", "main")
        within = Window.partitionBy("read", "main").orderBy("refr_pos", "main")
        islands = calls.withColumn("island", F.row_number().over(along) - F.row_number().over(within)).filter("main = 1")
        runs = islands.groupBy("read", "island").agg(F.count("*").alias("run"))
        return runs.filter(compare(F.col("run"), check.op, check.threshold)).select("read").distinct()

    def _fails_missing(self, check: Check) -> DataFrame:
        of_measure = self._names.filter(F.col("measure") == check.measure.name).select("name")
        return self.hits.select("read").distinct().join(self.hits.join(F.broadcast(of_measure), "name").select("read"), "read", "left_anti")

    def _fails_listed(self, check: Check) -> DataFrame:
        names = check.argument.toDF("qname").filter("qname IS NOT NULL")
        return self.hits.join(names, "qname", "left_semi").select("read").distinct()

    def _fails_blocks(self, check: Check) -> DataFrame:
        """Sites whose position and strand is covered by so many blocks."""
        sites = self.site_all().filter(F.col("relation") == self._relation(check.relation).name)
        return sites.withColumn("bad", self._blocks_fail(check)).filter("bad").select(*SITE)

    def _fails_position(self, check: Check) -> DataFrame:
        """Every site, of any relation, at positions whose pooled evidence fails."""
        spot = Window.partitionBy("contig", "refr_pos")
        return self.site_all().withColumn("bad", self._position_fails(check, spot)).filter("bad").select(*SITE)

    def _fails_in_regions(self, check: Check) -> DataFrame:
        return self._by_regions(check.argument, "left_semi")

    def _fails_outside_regions(self, check: Check) -> DataFrame:
        return self._by_regions(check.argument, "left_anti")

    def _by_regions(self, regions: DataFrame, how: str) -> DataFrame:
        """Sites in or outside half-open 0-based regions, matched by contig and bin.

        A region is repeated for the bins that it spans, so that the join has equal keys
        and no region table needs to be broadcast.  A semi or anti join keeps a site
        once, however many regions hold it.
        """
        r = regions.select(F.col("contig").alias("rc"), F.col("start").cast("bigint").alias("lo"), F.col("end").cast("bigint").alias("hi")).filter("lo < hi")
        r = r.withColumn("rb", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN))))
        at = pos0(F.col("refr_pos"), self.base)
        sites = self.site_all().withColumn("at", at).withColumn("bin", F.floor(at / BIN))
        return sites.join(r, F.expr("contig = rc AND bin = rb AND at >= lo AND at < hi"), how).select(*SITE)

    # what is left

    def all_rejected(self, checks: list[Check], level: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), (self.rejected(c, level) for c in checks))

    def resolve(self, drop_reads: list[Check], drop_blocks: list[Check]) -> DataFrame:
        """Hits of reads and blocks that no check rejects."""
        out = self.hits
        if drop_reads:
            out = out.join(self.all_rejected(drop_reads, "read"), "read", "left_anti")
        if drop_blocks:
            out = without_blocks(out, self.all_rejected(drop_blocks, "block"))
        return out

    def site_relation(self, drop_sites: list[Check] = ()) -> DataFrame:
        """Sites that no check rejects; a site that fails by one relation is gone from all.

        Counts are taken once; what a window over them decides is flagged there, and only
        the other checks need a join.
        """
        sites = self.site_all()
        flags = [(check, self._site_flag(check.at("site"))) for check in drop_sites]
        for i, (_, flag) in enumerate(flags):
            if flag is not None:
                sites = sites.withColumn(f"_bad{i}", F.coalesce(flag, F.lit(False)))
        told = [f"_bad{i}" for i, (_, flag) in enumerate(flags) if flag is not None]
        if told:
            sites = sites.filter(~reduce(Column.__or__, map(F.col, told))).drop(*told)
        others = [check for check, flag in flags if flag is None]
        if not others:
            return sites
        bad = self.all_rejected(others, "site").distinct().select(*(F.col(c).alias(f"bad_{c}") for c in SITE))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"bad_{c}")) for c in SITE))
        return sites.join(bad, same, "left_anti")


def without_blocks(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """SQL's NOT IN: a null block goes too when anything is rejected, and a null among the rejected leaves nothing.

    Rejected blocks are broadcast: they have a row each, while a shuffle of the rows by
    block would put a block's hits, and all of its sites behind them, into one task.
    """
    facts = bad.agg(F.count("*").alias("bad_rows"), F.count("block").alias("bad_known"))
    kept = rows.join(F.broadcast(bad.filter("block IS NOT NULL").distinct()), "block", "left_anti")
    kept = kept.crossJoin(F.broadcast(facts))  # one row
    return kept.filter("bad_rows = 0 OR (bad_rows = bad_known AND block IS NOT NULL)").select(*rows.columns)


def block_summary(site_relation: DataFrame) -> DataFrame:
    sums = (F.sum(c).cast("bigint").alias(c) for c in ("num", "den"))
    return site_relation.filter("den > 0").groupBy("block", "relation").agg(*sums, F.count("*").alias("sites"))
