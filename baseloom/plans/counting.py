"""Queries of the counting, judging and writing operators, over hits made of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.operators import evidence as E
from baseloom.operators.measures import both, in_regions, at_position, listed, outside_regions
from baseloom.plans import bridges as B
from baseloom.plans.run import Run
from baseloom.sinks import sites as sinks

QUERIES: dict = {}


def _add(name: str, sql: str | None):
    def take(function):
        QUERIES[name] = (function, sql and f"WITH {B.SQL.strip()}\n{sql.strip()}")
        return function

    return take


def _run(spark, d) -> Run:
    """Reads that look unconverted go; the sites of mCG are folded."""
    ch = B.MCH.relate()
    return Run(B.hits(spark, d), block="cell").measures(B.MCG, B.MCH).drop_reads(both(ch.total.ge(3), ch.ratio.gt(0.6))).merge_strands(B.MCG)


def _all(spark, d) -> E.Evidence:
    return Run(B.hits(spark, d), block="cell").measures(B.MCG, B.MCH).evidence()


def _read(df):
    return df.select("read.qname", "read.mate", *(c for c in df.columns if c != "read"))


@_add("src_where", "SELECT qname, mate, block, name, contig, refr_pos, strand, qual FROM src WHERE (qual >= 40 OR strand = '+') AND (name = 'CG')")
def src_where(spark, d):
    src = Run(B.hits(spark, d), block="cell").where("qual >= 40", "strand = '+'").where("name = 'CG'").src()
    return src.select("qname", "mate", "block", "name", "contig", "refr_pos", "strand", "qual")


@_add("block_joined", "SELECT block || '.' || strand AS block, count(*) AS n FROM src GROUP BY ALL")
def block_joined(spark, d):
    return E.source(B.hits(spark, d), block=["cell", "strand"]).groupBy("block").agg(F.count("*").alias("n"))


@_add("positions", "SELECT contig, refr_pos - 0 AS p0, refr_pos + 1 AS p1, refr_pos - 1 AS q0, count(*) AS n FROM src GROUP BY ALL")
def positions(spark, d):
    from baseloom.functions.columns import pos0, pos1

    p = F.col("refr_pos")
    return B.hits(spark, d).groupBy("contig", pos0(p).alias("p0"), pos1(p).alias("p1"), pos0(p, 1).alias("q0")).agg(F.count("*").alias("n"))


@_add("read_category", "SELECT read.qname AS qname, read.mate AS mate, measure, category, count(*) AS n FROM src JOIN measure USING (name) GROUP BY ALL")
def read_category(spark, d):
    return _read(_all(spark, d).read_category())


@_add("block_category", "SELECT block, measure, category, count(*) AS n FROM src JOIN measure USING (name) GROUP BY ALL")
def block_category(spark, d):
    return _all(spark, d).block_category()


@_add("read_relation", "SELECT read.qname AS qname, read.mate AS mate, relation, num, den FROM read_relation")
def read_relation(spark, d):
    return _read(_all(spark, d).read_relation())


@_add("block_relation", "SELECT block, relation, num, den FROM block_relation")
def block_relation(spark, d):
    return _all(spark, d).block_relation()


@_add("block_extent", "SELECT block, relation, reads, sites FROM block_extent")
def block_extent(spark, d):
    return _all(spark, d).block_extent()


def _fails(level: str, check, sql: str):
    columns = {"read": "read.qname AS qname, read.mate AS mate", "block": "block", "site": "block, contig, refr_pos, strand"}[level]

    def run(spark, d):
        run = _run(spark, d) if level == "site" else Run(B.hits(spark, d), block="cell").measures(B.MCG, B.MCH)
        got = run.evidence().rejected(check(spark, d) if callable(check) else check, level)
        return _read(got) if level == "read" else got

    return run, f"SELECT {columns} FROM {sql}"


CG, CH = B.MCG.relate(), B.MCH.relate()
_CHECKS = {
    "read_fails_main": ("read", CH.main.ge(2), "read_relation WHERE relation = 'mCH' AND num >= 2"),
    "read_fails_other": ("read", CH.other.lt(2), "read_relation WHERE relation = 'mCH' AND den - num < 2"),
    "read_fails_total": ("read", CG.total.le(3), "read_relation WHERE relation = 'mCG' AND den <= 3"),
    "read_fails_ratio": ("read", CH.ratio.gt(0.4), "read_relation WHERE relation = 'mCH' AND num::DOUBLE / den > 0.4"),
    "read_fails_equal": ("read", CG.main.eq(4), "read_relation WHERE relation = 'mCG' AND num = 4"),
    "read_fails_unequal": ("read", CG.main.ne(4), "read_relation WHERE relation = 'mCG' AND num <> 4"),
    "read_fails_consecutive": ("read", CH.consecutive.ge(2), "(SELECT DISTINCT read FROM runs WHERE run >= 2)"),
    "read_fails_missing": ("read", B.MCH.missing(), "(SELECT DISTINCT read FROM src WHERE read NOT IN (SELECT read FROM src JOIN measure USING (name) WHERE measure = 'mCH'))"),
    "read_fails_listed": ("read", lambda s, d: listed(B.names(s, d)), "(SELECT DISTINCT read FROM src WHERE qname IN (SELECT 'r' || CAST(o_custkey * 3 AS VARCHAR) FROM orders))"),
    "both_ladder": ("read", both(CH.total.ge(2), CH.total.le(4), CH.main.gt(1)), "read_relation WHERE relation = 'mCH' AND den >= 2 AND den <= 4 AND num > 1"),
    "block_fails": ("block", CG.ratio.lt(0.501), "block_relation WHERE relation = 'mCG' AND num::DOUBLE / den < 0.501"),
    "block_fails_reads": ("block", CG.reads.ge(1000), "block_extent WHERE relation = 'mCG' AND reads >= 1000"),
    "block_fails_sites": ("block", CH.sites.ge(2400), "block_extent WHERE relation = 'mCH' AND sites >= 2400"),
    "site_fails": ("site", CG.total.lt(3), "site_all WHERE relation = 'mCG' AND den < 3"),
    "site_fails_blocks": ("site", CG.blocks.lt(2), "(SELECT s.* FROM site_all s JOIN (SELECT contig, refr_pos, strand, count(DISTINCT block) AS blocks FROM site_all WHERE relation = 'mCG' AND den > 0 GROUP BY ALL) b USING (contig, refr_pos, strand) WHERE s.relation = 'mCG' AND blocks < 2)"),
    "site_in_regions": ("site", lambda s, d: in_regions(B.regions(s, d)), "site_all s WHERE EXISTS (SELECT 1 FROM regions r WHERE r.contig = s.contig AND s.refr_pos >= lo AND s.refr_pos < hi)"),
    "site_outside_regions": ("site", lambda s, d: outside_regions(B.regions(s, d)), "site_all s WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.contig = s.contig AND s.refr_pos >= lo AND s.refr_pos < hi)"),
    "site_fails_position": ("site", at_position(CG.total.lt(8)), "(SELECT s.* FROM site_all s JOIN pooled p USING (contig, refr_pos) WHERE p.den < 8)"),
}
for _name, (_level, _check, _sql) in _CHECKS.items():
    _function, _text = _fails(_level, _check, _sql)
    _add(_name, _text)(_function)


@_add("resolved", "SELECT read.qname AS qname, read.mate AS mate, block, name, contig, refr_pos, strand, qual FROM resolved WHERE block NOT IN (SELECT block FROM bad_blocks)")
def resolved(spark, d):
    out = _run(spark, d).drop_blocks(CG.reads.lt(940)).resolved()
    return out.select("qname", "mate", "block", "name", "contig", "refr_pos", "strand", "qual")


@_add("site_stranded", "SELECT * FROM site_stranded")
def site_stranded(spark, d):
    return _run(spark, d).evidence().site_stranded()


@_add("merge_strands", "SELECT * FROM site_category")
def merge_strands(spark, d):
    return _run(spark, d).evidence().site_category()


@_add("site_all", "SELECT * FROM site_all")
def site_all(spark, d):
    return _run(spark, d).evidence().site_all()


_DROPPED = "site_all s WHERE (block, contig, refr_pos, strand) NOT IN (SELECT (block, contig, refr_pos, strand) FROM site_all WHERE relation = 'mCG' AND den < 3)"


@_add("drop_sites", f"SELECT * FROM {_DROPPED}")
def drop_sites(spark, d):
    return _run(spark, d).drop_sites(CG.total.lt(3)).sites()


@_add("block_summary", "SELECT block, relation, sum(num)::BIGINT AS num, sum(den)::BIGINT AS den, count(*) AS sites FROM site_all WHERE den > 0 GROUP BY ALL")
def block_summary(spark, d):
    return _run(spark, d).summary()


_POOL = "(SELECT contig, refr_pos, sum(num)::BIGINT AS num, sum(den)::BIGINT AS den FROM site_all WHERE relation = 'mCG' GROUP BY ALL HAVING sum(den) >= 2)"
_POOL_STRAND = "(SELECT contig, refr_pos, strand, sum(num)::BIGINT AS num, sum(den)::BIGINT AS den FROM site_all WHERE relation = 'mCH' GROUP BY ALL)"


@_add("bedgraph", f"""SELECT contig, refr_pos AS start, refr_pos + 1 AS "end", printf('%.15g', 100.0 * num / den) AS percent FROM {_POOL}""")
def bedgraph(spark, d):
    return _run(spark, d).bedgraph(B.MCG, min_depth=2)


@_add("bismark_cov", f"""SELECT contig, refr_pos + 1 AS start, refr_pos + 1 AS "end", printf('%.15g', 100.0 * num / den) AS percent, num AS methylated, den - num AS unmethylated FROM {_POOL}""")
def bismark_cov(spark, d):
    return _run(spark, d).bismark_cov(B.MCG, min_depth=2)


@_add("methyldackel", f"""SELECT contig, refr_pos AS start, refr_pos + 1 AS "end", floor(100.0 * num / den)::INTEGER AS percent, num AS methylated, den - num AS unmethylated FROM {_POOL}""")
def methyldackel(spark, d):
    return _run(spark, d).methyldackel_bedgraph(B.MCG, min_depth=2)


@_add("bedmethyl", f"""SELECT contig, refr_pos AS start, refr_pos + 1 AS "end", 'mCH' AS name, least(den, 1000) AS score, strand, refr_pos AS "thickStart", refr_pos + 1 AS "thickEnd", '0,0,0' AS "itemRgb", den AS coverage, printf('%.2f', 100.0 * num / den) AS percent FROM {_POOL_STRAND}""")
def bedmethyl(spark, d):
    return _run(spark, d).bedmethyl(B.MCH)


@_add("cgmap", """, tri(relation, name, main) AS (VALUES ('CGA', 'CG', 1), ('CGA', 'TG', 0), ('CAG', 'CHH', 1), ('CAG', 'THG', 0), ('CAA', 'CHH', 1), ('CAA', 'THH', 0)),
s AS (SELECT contig, refr_pos, strand, relation, round_even(sum(main) * 1.0 / count(*), 2) AS lev, sum(main)::BIGINT AS num, count(*)::BIGINT AS den FROM src JOIN tri USING (name) GROUP BY ALL)
SELECT contig, CASE strand WHEN '+' THEN 'C' WHEN '-' THEN 'G' END AS nucleotide, refr_pos + 1 AS pos,
  CASE WHEN substr(relation, 2, 1) = 'G' THEN 'CG' WHEN substr(relation, 3, 1) = 'G' THEN 'CHG' ELSE 'CHH' END AS class, substr(relation, 1, 2) AS dinucleotide,
  CASE WHEN lev = floor(lev) THEN printf('%.1f', lev) ELSE printf('%.15g', lev) END AS level, num AS mC, den AS total FROM s""")
def cgmap(spark, d):
    return Run(B.hits(spark, d), block="cell").measures(*B.TRI).rows("cgmap")


@_add("cellinfo", """, b AS (SELECT block, relation, sum(num)::BIGINT AS num, sum(den)::BIGINT AS den, count(*) AS sites FROM site_all WHERE den > 0 GROUP BY ALL)
SELECT block, sum(den)::BIGINT AS all_calls, (sum(sites) FILTER (relation = 'mCG'))::BIGINT AS cg_cov,
  printf('%.2f', 100.0 * sum(num) FILTER (relation = 'mCG') / nullif(sum(den) FILTER (relation = 'mCG'), 0)) AS cg_pct,
  (sum(sites) FILTER (relation = 'mCH'))::BIGINT AS ch_cov,
  printf('%.2f', 100.0 * sum(num) FILTER (relation = 'mCH') / nullif(sum(den) FILTER (relation = 'mCH'), 0)) AS ch_pct
FROM b GROUP BY block HAVING coalesce(sum(sites) FILTER (relation = 'mCG'), 0) >= 10""")
def cellinfo(spark, d):
    return _run(spark, d).cellinfo(cg_relation=B.MCG, ch_relation=B.MCH, min_sites=10)


@_add("sites_parquet", "SELECT * FROM site_all WHERE den > 0")
def sites_parquet(spark, d):
    return _run(spark, d).rows("sites_parquet")


@_add("amethyst", "SELECT block, contig AS chr, refr_pos + 1 AS pos, num AS c, den - num AS t FROM site_all WHERE relation = 'mCG' AND den > 0")
def amethyst(spark, d):
    contigs = spark.createDataFrame([(f"chr{i + 1}", i) for i in range(5)], "name string, i bigint")
    return _run(spark, d).rows("amethyst", B.MCG, contigs=contigs)


@_add("report", f"""SELECT 0 AS ord, 'reads seen' AS what, count(DISTINCT read) AS n FROM src
UNION ALL SELECT 1, 'reads kept', count(DISTINCT read) FROM resolved WHERE block NOT IN (SELECT block FROM bad_blocks)
UNION ALL SELECT 2, 'read mCH total >= 3 and mCH ratio > 0.6', count(*) FROM bad_reads
UNION ALL SELECT 3, 'block mCG reads < 940', count(*) FROM bad_blocks
UNION ALL SELECT 4, 'site mCG total < 3', count(*) FROM site_all_r WHERE relation = 'mCG' AND den < 3""".replace("site_all_r", "(SELECT block, contig, CASE WHEN strand = '-' AND measure = 'mCG' THEN refr_pos - 1 ELSE refr_pos END AS pos, CASE WHEN measure = 'mCG' THEN '+' ELSE strand END AS st, measure AS relation, sum(n) AS den FROM site_stranded WHERE block NOT IN (SELECT block FROM bad_blocks) GROUP BY ALL)"))
def report(spark, d):
    return _run(spark, d).drop_blocks(CG.reads.lt(940)).drop_sites(CG.total.lt(3)).report()
