"""What the scanning queries cost: reads are made and shuffled once, and columns and characters stay in Python."""

import pytest
from pyspark.sql import functions as F

from baseloom.functions import codes as K
from baseloom.operators import hits, patterns, strand, tags, walk
from baseloom.plans import reads as R
from tests.scan import plain
from tests.scan.test_tags import TAGS

SF = "/root/testdata/sf0.001"


def called(spark, rows):
    return walk.with_geometry(strand.rule("directional").call(plain.frame(spark, rows)))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reads_are_made_once_for_tiles(spark, monkeypatch):
    """However far they reach: introns here span tiles of several levels."""
    refs = plain.genomes(7)
    rows = plain.records(7, refs)
    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    reads = called(spark, rows)
    tracked = reads.mapInArrow(counted, reads.schema)
    monkeypatch.setattr(walk, "TILE", 8)
    monkeypatch.setattr(walk, "LARGER", 2)
    got = walk.with_reference(tracked, plain.contigs(spark, refs), 5, broadcast_bases=1).select("record_id", "refr").collect()
    assert count.value == len(rows) == len(got)
    for r in got:
        _, _, contig, pos, ops, _ = rows[r.record_id]
        span = range(pos - 5, pos + sum(n for op, n in ops if op in "MDN=X") + 5)
        assert r.refr == "".join(refs[contig][p] if 0 <= p < len(refs[contig]) else "_" for p in span)


def test_tiles_are_linear():
    """Tiles of all levels hold few times the contig's bases, and each contig is read once."""
    import pyarrow as pa

    contig = "ACGTTGCA" * 20_000
    out = pa.Table.from_batches(walk._tiles(iter([pa.RecordBatch.from_pydict({"contig": ["a", "b"], "seq": [contig, "AC"]})]), 1 << 10)).to_pylist()
    assert sum(len(x["part"]) for x in out) < 5 * len(contig)
    assert all(x["part"] == contig[x["tile_start"] : x["tile_start"] + len(x["part"])] for x in out if x["ref_name"] == "a")
    assert [(x["level"], x["tile"], x["part"]) for x in out if x["ref_name"] == "b"] == [(0, 0, "AC")]


@pytest.mark.parametrize("piece", [1, 700])
def test_pieces_change_nothing(spark, monkeypatch, piece):
    import pyarrow as pa

    refs = plain.genomes(4)
    reads = walk.with_reference(called(spark, plain.records(4, refs)), plain.contigs(spark, refs), 4)
    batch = reads.select("record_id", *walk.NEEDS).toArrow().combine_chunks().to_batches()[0]
    whole = walk.columns_of(batch, walk.Steps(4, 2, True))
    parts = [walk.columns_of(p, walk.Steps(4, 2, True)) for p in walk.pieces(batch, piece)]
    assert len(parts) > 3
    for k in ("rd", "rf", "pos", "off", "q"):
        assert [x for p in parts for x in getattr(p, k).tolist()] == getattr(whole, k).tolist()
    assert list(walk.pieces(pa.RecordBatch.from_pylist([], batch.schema))) == []


def test_tags_are_read_back_in_python(spark):
    """Without a row of the JVM for each base, and with all checks."""
    refs = {k: v.replace("N", "C") for k, v in plain.genomes(12).items()}
    queries = patterns.load(TAGS)
    steps = hits.steps_for(queries)
    reads = walk.with_reference(called(spark, plain.records(12, refs, 30, "MDI")), plain.contigs(spark, refs), steps.flank)
    tagged = tags.with_tags(reads, queries, steps)
    assert "Generate" not in plan_of(tags.extract(tagged, queries)).split("MapInArrow", 1)[0]
    assert "transform(" not in plan_of(tags.extract(tagged, queries))
    other = lambda kind, value: tagged.withColumn("tags", F.create_map(F.lit("Xm"), F.struct(F.lit(kind).alias("type"), value.alias("value"))))
    for kind, value, why in (("i", F.lit("1"), "isn't text"), ("Z", F.lit("K"), "differ in length"), ("Z", F.repeat(F.lit("?"), F.length("seq")), r"no code \?")):
        with pytest.raises(Exception, match=why):
            tags.extract(other(kind, value), queries).collect()
    missing = tagged.withColumns({"tags": F.create_map().cast(R.TAGS)})
    assert tags.extract(missing, queries).count() == 0
    # a record without qualities, and a CIGAR that is shorter than SEQ
    bare = other("Z", F.rpad(F.lit(""), F.length("seq"), F.lit("K"))).withColumns({"quals": F.lit(None).cast("array<int>"), "cigar": F.lit("1M")})
    got = tags.extract(bare, queries, fields=["qname"])
    assert got.filter("qual IS NOT NULL").count() == 0 and got.filter("refr_pos IS NOT NULL").count() == 30 and got.columns[:2] == ["record_id", "qname"]


def test_walked_text_stays_in_python(spark):
    """No array of columns reaches the JVM."""
    for shape in R.SHAPES:
        assert "cols" not in plan_of(R.walked(spark, SF, shape))
    refs = plain.genomes(8)
    reads = walk.with_reference(called(spark, plain.records(8, refs)), plain.contigs(spark, refs), 3)
    got = {r.record_id: r for r in walk.spelled(reads, walk.Steps(3, 2, True)).collect()}
    for r in walk.walk(reads, 3, 2, True).select("record_id", "cols").collect():
        text = lambda k: "".join(K.name_of(c[k]) for c in r.cols)  # noqa: E731, B023
        total = lambda k: sum(c[k] or 0 for c in r.cols)  # noqa: E731, B023
        assert tuple(got[r.record_id]) == (r.record_id, text("rd"), text("rf"), total("pos"), total("off"), total("q"))


def test_bridge_makes_no_array_of_letters(spark):
    assert "split(" not in plan_of(R.reads(spark, SF)) and "regexp_replace" not in plan_of(R.contigs(spark, SF))
