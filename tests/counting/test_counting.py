"""Counts, checks and formats of random hits against plain dictionaries."""

import re

import pytest
from pyspark.sql import functions as F

from baseloom.functions import numbers
from baseloom.operators import evidence as E
from baseloom.operators import partition, verify
from baseloom.operators.measures import DeclarationError, Measure, at_position, both, fails, in_regions, listed, outside_regions
from baseloom.plans.run import Run
from baseloom.sinks import sites as sinks
from baseloom.streaming import hits as streaming
from tests.counting import plain

CG = Measure("mCG", methylated="CG", unmethylated="TG")
CH = Measure("mCH", methylated=["CHG", "CHH"], unmethylated=["THG", "THH"])


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return plain.hits(request.param)


@pytest.fixture(scope="module")
def hits(spark, rows):
    return spark.createDataFrame(rows, plain.SCHEMA).cache()


@pytest.fixture
def run(hits, spark):
    return Run(hits, block="XB", spark=spark).measures(CG, CH)


def table(df):
    return sorted(map(tuple, df.collect()))


def flat(counts):
    return sorted((*k, *v) for k, v in counts.items())


def reads(run, check):
    return {r.qname for r in run.evidence().rejected(check, "read").select("read.qname").collect()}


def test_levels(run, rows):
    ev = run.evidence()
    assert table(ev.read_relation().select("read.qname", "relation", "num", "den")) == flat(plain.tally(rows, plain.read))
    assert table(ev.block_relation()) == flat(plain.tally(rows, plain.block))
    assert table(ev.site_all()) == flat(plain.tally(rows, plain.site()))
    assert table(run.merge_strands(CG).evidence().site_all()) == flat(plain.tally(rows, plain.site("mCG")))
    extent = {(b, m): x for m in plain.GROUPS for b, x in plain.extent(rows, m).items()}
    assert table(ev.block_extent()) == flat(extent)


def test_read_checks(run, rows, spark):
    by_read = plain.tally(rows, plain.read)
    expect = lambda relation, test: {q for (q, r), (n, d) in by_read.items() if r == relation and test(n, d)}
    assert reads(run, CH.ratio.gt(0.5)) == expect("mCH", lambda n, d: n / d > 0.5)
    assert reads(run, CH.main.ge(4)) == expect("mCH", lambda n, d: n >= 4) and reads(run, CG.other.eq(1)) == expect("mCG", lambda n, d: d - n == 1)
    assert reads(run, CG.total.le(2)) == expect("mCG", lambda n, d: d <= 2) and reads(run, CG.main.ne(1)) == expect("mCG", lambda n, d: n != 1)
    assert reads(run, both(CH.total.ge(3), CH.ratio.lt(0.5))) == expect("mCH", lambda n, d: d >= 3 and n / d < 0.5)
    assert reads(run, both(CG.total.ge(3), CH.ratio.lt(0.5))) == expect("mCG", lambda n, d: d >= 3) & expect("mCH", lambda n, d: n / d < 0.5)
    for k in (1, 2, 4):
        assert reads(run, CH.consecutive.ge(k)) == {q for q, best in plain.longest_runs(rows, "mCH").items() if best >= k}
    assert reads(run, CG.missing()) == {h[0] for h in rows} - {q for q, r in by_read if r == "mCG"}
    assert reads(run, listed(spark.createDataFrame([("read3",), (None,), ("nobody",)], "n string"))) == {"read3"}
    assert reads(run, fails(lambda ev: ev.hits.filter("qual > 38").select("read").distinct(), "read")) == {h[0] for h in rows if h[7] > 38}


def test_named_relations(run, rows):
    """Categories of a measure, some against others."""
    ctx = Measure("ctx", hh="CHH", hg="CHG", converted=["THH", "THG"])
    part = ctx.relate("hh", "hg")
    run.measures(part)
    counts = {}
    for h in rows:
        if h[3] in ("CHH", "CHG", "THH", "THG"):
            n, d = counts.get(h[0], (0, 0))
            counts[h[0]] = (n + (h[3] == "CHH"), d + (h[3] in ("CHH", "CHG")))
    assert part.name == "ctx.hh_vs_hg" and reads(run, part.ratio.gt(0.6)) == {q for q, (n, d) in counts.items() if d and n / d > 0.6}
    assert ctx.relate("hh").other_side == ("hg", "converted") and ctx.relate(["hh", "hg"], name="kept").name == "kept" and CG.relate().name == "mCG"


def test_block_and_site_checks(run, rows, spark):
    ev = run.evidence()
    extent, by_block, sites = plain.extent(rows, "mCG"), plain.tally(rows, plain.block), plain.tally(rows, plain.site())
    at = lambda check: sorted(set(map(tuple, ev.rejected(check, "site").collect())))
    blocks = lambda check: {r.block for r in ev.rejected(check, "block").collect()}
    middle = sorted(x for x, _ in extent.values())[1]
    assert blocks(CG.reads.le(middle)) == {b for b, (x, _) in extent.items() if x <= middle} != set()
    most = max(x for _, x in extent.values())
    assert blocks(CG.sites.ge(most)) == {b for b, (_, x) in extent.items() if x == most}
    assert blocks(CG.ratio.lt(0.5)) == {b for (b, r), (n, d) in by_block.items() if r == "mCG" and n / d < 0.5}
    assert at(CG.total.lt(2)) == sorted(k[:4] for k, (n, d) in sites.items() if k[4] == "mCG" and d < 2)
    cover = {}
    for b, c, p, s, r in sites:
        if r == "mCG":
            cover.setdefault((c, p, s), set()).add(b)
    assert at(CG.blocks.lt(2)) == sorted(k[:4] for k in sites if k[4] == "mCG" and len(cover[k[1:4]]) < 2)
    pool = plain.pooled(sites, "mCG", (1, 2))
    assert at(at_position(CG.total.ge(4))) == sorted({k[:4] for k in sites if pool.get(k[1:3], (0, 0))[1] >= 4})
    bed = [("chr1", 20, 41), ("chr1", 25, 61), ("chr2", 0, 40_000), ("chr3", 71, 71)]
    inside = lambda k: any(c == k[1] and lo <= k[2] < hi for c, lo, hi in bed)
    frame = spark.createDataFrame(bed, "contig string, start bigint, end bigint")
    assert at(in_regions(frame)) == sorted({k[:4] for k in sites if inside(k)}) and at(outside_regions(frame)) == sorted({k[:4] for k in sites if not inside(k)})
    for check, bad in ((CG.total.lt(2), lambda k: sites.get((*k[:4], "mCG"), (0, 9))[1] < 2), (at_position(CG.total.ge(4)), lambda k: pool.get(k[1:3], (0, 0))[1] >= 4), (in_regions(frame), inside), (both(CG.total.ge(2), CG.ratio.gt(0.4)), lambda k: (x := sites.get((*k[:4], "mCG"))) and x[1] >= 2 and x[0] / x[1] > 0.4)):
        out = Run(run.src().drop("read", "block"), block="XB", spark=spark).measures(CG, CH).drop_sites(check).sites()
        assert table(out) == flat({k: v for k, v in sites.items() if not bad(k)})


@pytest.fixture
def kept(run):
    return run.drop_reads(CH.ratio.gt(0.7), CG.missing()).drop_blocks(CG.reads.lt(3))


@pytest.fixture
def left(rows):
    """Hits of what ``kept`` keeps."""
    by_read, extent = plain.tally(rows, plain.read), plain.extent(rows, "mCG")
    bad = {q for (q, r), (n, d) in by_read.items() if r == "mCH" and n / d > 0.7} | {h[0] for h in rows if (h[0], "mCG") not in by_read}
    return plain.without(rows, bad, {b for b, (x, _) in extent.items() if x < 3})


def test_formats(kept, left, spark, tmp_path):
    kept.merge_strands(CG)
    sites = plain.tally(left, plain.site("mCG"))
    pool = plain.pooled(sites, "mCG", (1, 2))
    assert pool and table(kept.sites()) == flat(sites)
    got = lambda df: [tuple(r) for r in df.collect()]
    assert got(kept.bismark_cov(CG)) == [(c, p + 1, p + 1, f"{100 * n / d:.15g}", n, d - n) for (c, p), (n, d) in pool.items()]
    assert got(kept.bedgraph(CG, min_depth=2)) == [(c, p, p + 1, f"{100 * n / d:.15g}") for (c, p), (n, d) in pool.items() if d >= 2]
    assert got(kept.methyldackel_bedgraph(CG)) == [(c, p, p + 1, 100 * n // d, n, d - n) for (c, p), (n, d) in pool.items()]
    stranded = plain.pooled(sites, "mCH", (1, 2, 3))
    assert got(kept.bedmethyl(CH)) == [(c, p, p + 1, "mCH", d, s, p, p + 1, "0,0,0", d, f"{100 * n / d:.2f}") for (c, p, s), (n, d) in stranded.items()]
    cells = {}
    for (b, *_, r), (n, d) in sites.items():
        x = cells.setdefault(b, {"mCG": [0, 0, 0], "mCH": [0, 0, 0]})[r]
        x[0], x[1], x[2] = x[0] + n, x[1] + d, x[2] + 1
    percent = lambda x: f"{100 * x[0] / x[1]:.2f}" if x[1] else None
    assert got(kept.cellinfo(cg_relation=CG, ch_relation=CH)) == [(b, x["mCG"][1] + x["mCH"][1], x["mCG"][2] or None, percent(x["mCG"]), x["mCH"][2] or None, percent(x["mCH"])) for b, x in sorted(cells.items())]
    assert kept.rows("sites_parquet").columns == ["block", "contig", "refr_pos", "strand", "relation", "num", "den"]
    lines = ["\t".join(map(str, x)) for x in got(kept.bismark_cov(CG))]
    for single in (False, True):
        kept.bismark_cov(CG, out=str(tmp_path / f"cov{single}"), single=single)
        assert [r.value for r in spark.read.text(str(tmp_path / f"cov{single}")).collect()] == lines
    assert len([p for p in (tmp_path / "covTrue").iterdir() if p.suffix == ".csv"]) == 1
    contigs = spark.createDataFrame([("chr3", 0), ("chr1", 1), ("chr2", 2)], "name string, i bigint")
    order = {"chr3": 0, "chr1": 1, "chr2": 2}
    expected = sorted(((k[0], k[1], k[2] + 1, n, d - n) for k, (n, d) in sites.items() if k[4] == "mCG"), key=lambda x: (x[0], order[x[1]], x[2]))
    assert got(kept.rows("amethyst", CG, contigs=contigs)) == expected
    sinks.write_amethyst(kept.rows("amethyst", CG, contigs=contigs), str(tmp_path / "am"), "CG")
    assert spark.read.parquet(str(tmp_path / "am")).count() == len(expected)
    with pytest.raises(Exception, match="without a place"):
        kept.rows("amethyst", CG, contigs=contigs.limit(1)).collect()


def test_cgmap(run, rows, spark):
    tri = Measure("CGA", methylated="CG", unmethylated="TG")
    counts = plain.pooled({(*k[:4], "CGA"): v for k, v in plain.tally(rows, plain.site()).items() if k[4] == "mCG"}, "CGA", (1, 2, 3))
    got = Run(run.src().drop("read", "block"), block="XB", spark=spark).measures(tri).rows("cgmap").collect()
    assert [tuple(r) for r in got] == [(c, "C" if s == "+" else "G", p + 1, "CG", "CG", str(round(n / d, 2)), n, d) for (c, p, s), (n, d) in counts.items()]
    with pytest.raises(ValueError, match="CGmap"):
        run.rows("cgmap")


def test_report_and_resolution(kept, left, rows):
    assert table(kept.resolved().select("qname", "XB", "name", "refr_pos", "strand")) == sorted((h[0], h[2], h[3], h[5], h[6]) for h in left)
    kept.drop_sites(CG.total.lt(2))
    report = {r.what: r.n for r in kept.report().collect()}
    by_read, sites = plain.tally(rows, plain.read), plain.tally(left, plain.site())
    assert report == {
        "reads seen": len({h[0] for h in rows}), "reads kept": len({h[0] for h in left}),
        "read mCH ratio > 0.7": sum(r == "mCH" and n / d > 0.7 for (_, r), (n, d) in by_read.items()), "read mCG missing": len({h[0] for h in rows}) - sum(r == "mCG" for _, r in by_read),
        "block mCG reads < 3": sum(x < 3 for x, _ in plain.extent(rows, "mCG").values()), "site mCG total < 2": sum(k[4] == "mCG" and d < 2 for k, (n, d) in sites.items()),
    }


def test_declarations(run):
    with pytest.raises(KeyError):
        run.evidence().rejected(Measure("other", a="A", b="B").ratio.gt(1), "read")
    three = Measure("three", a="A", b="B", c="C")
    bad = (
        lambda: CG.total.lt(1), lambda: run.drop_blocks(CH.consecutive.ge(1)), lambda: Measure("m", a="A"), lambda: Measure("m", a="A", b="A"), lambda: Measure("", a="A", b="B"),
        lambda: three.relate(), lambda: three.relate("a", ["a"]), lambda: both(CG.ratio.gt(1)), lambda: run.measures(Measure("mCG", a="A", b="B")), lambda: (run.sites(), run.drop_sites(CG.total.lt(2))),
    )
    for make in bad:
        with pytest.raises(DeclarationError):
            make()


def test_null_blocks(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "block string")
    some = spark.createDataFrame([("a",)], "block string")
    assert table(E.without_blocks(df, some)) == [("b",)] and E.without_blocks(df, some.limit(0)).count() == 3
    assert E.without_blocks(df, some.union(spark.createDataFrame([(None,)], "block string"))).count() == 0
    assert table(E.source(spark.createDataFrame([("q", True, "x", None)], "qname string, mate boolean, c string, d string"), block=["c", "d"]).select("block")) == [("x",)]


def test_numbers(spark):
    pairs = [(n, d) for d in range(1, 60) for n in range(d + 1)] + [(1, 3_000), (7, 90_001), (1, 2_000_000)]
    df = spark.createDataFrame(pairs, "n bigint, d bigint").withColumn("x", F.lit(100.0) * F.col("n") / F.col("d"))
    for r in df.select("x", numbers.general15(F.col("x")).alias("g"), numbers.fixed(F.col("x"), 2).alias("f")).collect():
        assert (r.g, r.f) == ("%.15g" % r.x, "%.2f" % r.x)


def test_verification(spark):
    refs = spark.createDataFrame([("c", 14, "GATTCCAAGTCGAT")], "contig string, length bigint, seq string")
    seq, turned = "GATTCCAAGTCGAT", dict(zip("ACGT", "TGCA", strict=True))
    right = [("c", p, seq[p], "+") for p in range(14)] + [("c", p, turned[seq[p]], "-") for p in range(14)]
    schema = "contig string, refr_pos bigint, refr_base string, strand string"
    assert verify.check(spark.createDataFrame(right, schema), refs).passed
    late = spark.createDataFrame([(c, p - 1, b, s) for c, p, b, s in right if p], schema)
    with pytest.raises(ValueError, match="shift of 1: 26 of 26"):
        verify.check(late, refs)
    assert not verify.check(late, refs, strict=False).passed
    lists = spark.createDataFrame([("c", [p, p + 1], [seq[p], seq[p + 1]], "+") for p in range(13)], "contig string, capture_refr_pos array<bigint>, capture_refr array<string>, strand string")
    assert verify.check(lists, refs).passed and not verify.check(lists.withColumn("capture_refr_pos", F.transform("capture_refr_pos", lambda x: x + 2)), refs, strict=False).passed
    assert verify.check(spark.createDataFrame(right, schema), refs, sample=9, seed=4).checked == 9
    status = {r.contig: r.status for r in verify.contig_check(spark.createDataFrame([("x",), ("c",)], "contig string"), refs, spark.createDataFrame([("c", 11)], "contig string, length bigint")).collect()}
    assert status == {"x": "absent", "c": "wrong_length"}


def test_shards(spark):
    names = ["", "a", "read/1", "é" * 40, "q" * 99]
    df = spark.createDataFrame([(n,) for n in names], "qname string")
    got = {r.qname: r.h for r in df.select("qname", partition.fnv1a_column(F.col("qname")).alias("h")).collect()}
    assert {k: v % 2**64 for k, v in got.items()} == {n: partition.fnv1a(n.encode()) for n in names}
    shards = {r.qname: r.shard for r in partition.with_shards(df, 7).collect()}
    assert shards == {n: partition.fnv1a(n.encode()) % 7 for n in names}


def test_stream(spark, hits, tmp_path):
    hits.repartition(3).write.parquet(str(tmp_path / "in"))
    name = re.sub(r"\W", "", tmp_path.name)
    stream = streaming.stream_hits(spark, str(tmp_path / "in"), hits.schema, max_files=1, block="XB")
    query = streaming.site_counts(stream, [CG, CH]).writeStream.outputMode("complete").format("memory").queryName(f"sites_{name}").start()
    query.processAllAvailable()
    query.stop()
    batch = Run(hits, block="XB", spark=spark).measures(CG, CH).evidence().site_all()
    assert table(spark.table(f"sites_{name}")) == table(batch)
    assert set(sinks.FORMATS) == {"bedgraph", "bismark_cov", "methyldackel_bedgraph", "bedmethyl", "cgmap", "cellinfo", "sites_parquet", "amethyst"}


def test_sites_are_not_dealt_by_block(spark):
    """Few blocks may hold all hits: rejected ones are broadcast, and sites are summed by their whole keys."""
    import re

    from baseloom.plans import counting

    for name in ("report", "resolved"):
        plan = counting.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[block#", plan), name
        if name == "report":
            assert re.search(r"hashpartitioning\(block#\d+, contig#\d+, refr_pos#\d+", plan)
