"""Tags written from hits, and hits read back from them."""

import pytest
from pyspark.sql import functions as F

from baseloom.operators import hits, patterns, strand, tags, walk
from tests.scan import plain

QUERIES = '[query.kept]\nread = "C~"\nrefr = "C~"\n[query.changed]\nread = "T~"\nrefr = "C~"\n'
TAGS = QUERIES + '[tag.Xm.bases]\nfill = "-"\nK = "kept"\nt = "changed"\n[tag.Xo.strand]\nup = ["OT", "CTOT"]\ndown = ["OB", "CTOB"]'


def prepared(spark, rows, refs, steps):
    called = walk.with_geometry(strand.rule("directional").call(plain.frame(spark, rows)))
    return walk.with_reference(called, plain.contigs(spark, refs), steps.flank)


def test_round_trip(spark):
    refs = {k: v.replace("N", "C") for k, v in plain.genomes(12).items()}
    rows = plain.records(12, refs, 50, "MDI")
    queries = patterns.load(TAGS)
    steps = hits.steps_for(queries)
    reads = prepared(spark, rows, refs, steps)
    tagged = tags.with_tags(reads, queries, steps)
    for r in tagged.collect():
        _, flags, *_, seq = rows[r.record_id]
        cols = plain.columns(rows[r.record_id], refs, steps.flank, steps.splice_context, False, None)
        text = ["-"] * len(seq)
        for name, at in ((q.name, s) for s in range(len(cols) - 1) for q in queries.queries.values() if q.matches([c[0] for c in cols], [c[1] for c in cols], s)):
            off = cols[at][3]
            text[len(seq) - 1 - off if plain.bottom(flags) else off] = "K" if name == "kept" else "t"
        assert r.tags["Xm"].value == "".join(text) and r.tags["Xo"].value == ("down" if plain.bottom(flags) else "up") and r.unplaced == 0
    direct = hits.hit_rows(reads, queries, steps)
    back = tags.extract(tagged, queries)
    same = lambda df: sorted(map(str, df.select(direct.columns).collect()))
    assert same(back) == same(direct) and direct.count()
    with pytest.raises(Exception, match="there already"):
        tags.with_tags(tagged, queries, steps).collect()
    again = tags.with_tags(tagged.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("NM"), F.struct(F.lit("i").alias("type"), F.lit("1").alias("value"))))), queries, steps, overwrite=True)
    assert again.filter("size(tags) = 3").count() == 50


def test_rejects(spark):
    refs = plain.genomes(3)
    queries = patterns.load(TAGS + '\n[query.also]\nread = "C~"\nrefr = "{CN}~"\n[tag.Yy.bases]\nfill = "."\nK = "kept"\nA = "also"')
    steps = hits.steps_for(queries)
    reads = prepared(spark, plain.records(3, refs), refs, steps)
    with pytest.raises(Exception, match="two codes at one base"):
        tags.with_tags(reads, queries, steps).collect()
    gap = patterns.load('[query.gone]\nread = "."\nrefr = "N"\n[tag.Xg.bases]\nfill = "."\ng = "gone"')
    with pytest.raises(Exception, match="on a gap or skip"):
        tags.with_tags(reads, gap, steps).collect()
    for text in ('[tag.Xm.bases]\nK = "kept"', '[tag.Xm.bases]\nfill = "K"\nK = "kept"', '[tag.Xm.bases]\nfill = "."\nK = "none"', '[tag.X.bases]\nfill = "."\nK = "kept"', '[tag.Xm.strand]\nA = ["OT"]', '[tag.Xm.other]\na = "b"'):
        with pytest.raises(patterns.QueryError):
            tags.declared(patterns.load(QUERIES + "\n" + text))
    with pytest.raises(patterns.QueryError, match="which tag"):
        tags.choose(tags.declared(patterns.load(TAGS + '\n[tag.Yy.bases]\nfill = "."\nK = "kept"')))
