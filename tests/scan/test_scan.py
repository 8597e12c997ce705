"""Walks and scans of random records against the plain ones."""

import pytest
from pyspark.sql import functions as F

from baseloom.functions import codes as K
from baseloom.operators import hits, patterns, strand, walk
from tests.scan import plain

#: A few queries that together use sets, aliases, relations, wildcards, negation, marks, gaps and clips.
QUERIES = """
[alias]
y = "{CT}"
[pattern.any_base]
read = "N~"
refr = "~~"
[pattern.before_g]
read = "~~"
refr = "~G"
[query.step]
read = "yN"
refr = "CN"
[query.step_then_g]
where = "step and (before_g or not any_base)"
mark = ".+"
[query.equal]
read = "==="
refr = "~~~"
mark = ".+."
[query.unequal]
read = "/"
refr = "{AG}"
[query.edge]
read = "{_:}N"
refr = "~~"
[query.gap]
read = "N."
refr = "NN"
mark = ".+"
[query.splice]
read = ","
refr = ","
[query.inserted]
read = "N"
refr = "."
"""


def walked(spark, rows, refs, steps, rule="directional"):
    called = walk.with_geometry(strand.rule(rule).call(plain.frame(spark, rows)))
    return walk.with_reference(called, plain.contigs(spark, refs), steps.flank)


@pytest.mark.parametrize("seed, steps", [(1, walk.Steps(3, 2, True)), (2, walk.Steps(0, 0)), (3, walk.Steps(7, 4)), (4, walk.Steps(1, 1, True))])
def test_columns_and_hits(spark, seed, steps):
    refs = plain.genomes(seed)
    rows = plain.records(seed, refs)
    reads = walked(spark, rows, refs, steps)
    got = {r.record_id: [tuple(c) for c in r.cols] for r in walk.walk(reads, steps.flank, steps.splice_context, steps.insertions).collect()}
    queries = patterns.load(QUERIES)
    out = hits.hit_rows(reads, queries, steps).collect()
    for i, record in enumerate(rows):
        quals = [(7 * i + j) % 41 for j in range(len(record[5]))] if i % 5 else None
        expected = plain.columns(record, refs, steps.flank, steps.splice_context, steps.insertions, quals)
        assert got[i] == expected, record
        mine = [(r.name, r.read_5p, r.read_3p, r.refr_pos, r.qual, r.read_base, r.refr_base) for r in out if r.record_id == i]
        assert mine == plain.hits(record, expected, queries), record


def test_scan_of_everything(spark):
    """Unmapped, missing sequences, unknown strands and hitless records."""
    refs = plain.genomes(9)
    rows = plain.records(9, refs, 20)
    frame = plain.frame(spark, rows)
    frame = frame.withColumn("flags", F.when(F.col("record_id") == 3, 4).otherwise(F.col("flags"))).withColumn("seq", F.when(F.col("record_id") == 5, "*").otherwise(F.col("seq")))
    queries = patterns.load('[query.never]\nread = "{AR}"\nrefr = "."\n[query.step]\nread = "C"\nrefr = "C"')
    out = hits.scan(frame, plain.contigs(spark, refs), queries, strand.rule("directional"), fields=["strand", "qname"], only_hits=False).collect()
    assert {r.record_id for r in out} == set(range(20))
    assert all(r.name is None for r in out if r.record_id in (3, 5)) and {r.qname for r in out if r.record_id == 7} == {"q7"}
    only = hits.scan(frame, plain.contigs(spark, refs), queries, strand.rule("directional"), fields=["strand", "qname"]).collect()
    assert sorted(map(str, only)) == sorted(str(r) for r in out if r.name is not None)
    with pytest.raises(Exception, match="contig isn't in the reference"):
        hits.scan(frame, plain.contigs(spark, {"g0": refs["g0"]}), queries, strand.rule("directional")).collect()
    m5 = spark.createDataFrame([("g0", "x"), ("g1", None), ("g2", None)], "ref_name string, m5 string")
    with pytest.raises(Exception, match="no checksum"):
        hits.scan(frame, plain.contigs(spark, refs), queries, strand.rule("directional"), md5s=m5).collect()


def test_empty(spark):
    refs = plain.genomes(2)
    reads = walked(spark, plain.records(2, refs, 4), refs, walk.Steps(2, 2)).filter("false")
    assert hits.hit_rows(reads, patterns.load(QUERIES), walk.Steps(2, 2)).collect() == []
    assert hits.concordance(reads, walk.Steps(2, 2)).first() == (0, 0)


def test_captures(spark):
    """Lists show what the columns of the window are."""
    steps = walk.Steps(2, 2)
    refs = plain.genomes(6)
    rows = plain.records(6, refs, 30, "MD")
    queries = patterns.load('[query.pair]\nread = "NN"\nrefr = "~~"\nmark = "^+"\n[query.gap]\nread = "N.{N.}"\nrefr = "~~~"\nmark = "+^^"')
    out = hits.hit_rows(walked(spark, rows, refs, steps), queries, steps).collect()
    assert {r.name for r in out} == {"pair", "gap"}
    for i, record in enumerate(rows):
        cols = plain.columns(record, refs, 2, 2, False, [(7 * i + j) % 41 for j in range(len(record[5]))] if i % 5 else None)
        expected = []
        for last in range(len(cols)):
            for q in queries.queries.values():
                at = last - q.span + 1
                if at >= 0 and q.matches([c[0] for c in cols], [c[1] for c in cols], at):
                    got = [cols[at + j] for j in q.captures]
                    ends = [plain.ends(record, c[3]) if c[0] < K.GAP else (None, None) for c in got]
                    expected.append((q.name, list(q.captures), [K.name_of(c[0]) for c in got], [K.name_of(c[1]) for c in got], [c[4] for c in got], [e[0] for e in ends], [e[1] for e in ends], [c[2] for c in got]))
        mine = [(r.name, r.capture_col, r.capture_read, r.capture_refr, r.capture_qual, r.capture_read_5p, r.capture_read_3p, r.capture_refr_pos) for r in out if r.record_id == i]
        assert mine == expected


def test_tiles_equal_broadcast(spark, monkeypatch):
    refs = plain.genomes(5)
    called = walk.with_geometry(strand.rule("directional").call(plain.frame(spark, plain.records(5, refs))))
    monkeypatch.setattr(walk, "TILE", 8)
    a, b = (walk.with_reference(called, plain.contigs(spark, refs), 5, broadcast_bases=n).select("record_id", "refr", "refr_start").orderBy("record_id").collect() for n in (1 << 20, 1))
    assert a == b and any(r.refr.startswith("_____") for r in a)


@pytest.mark.parametrize("rule, tags, flags, expected", [
    ("bismark", {"XR": ("Z", "GA"), "XG": ("Z", "CT")}, 147, ("forward", "reverse")), ("bismark", {"XR": ("Z", "CT"), "XG": ("Z", "GA")}, 83, ("reverse", "reverse")),
    ("astair", {}, 83, ("reverse", "reverse")), ("astair", {}, 1, ("unknown", None)),
    ("biscuit", {"YD": ("A", "u")}, 0, ("unknown", None)), ("bwameth", {"YD": ("Z", "r")}, 0, ("reverse", "forward")),
    ("bs-seeker2-se", {"XO": ("Z", "-RC")}, 0, ("reverse", "forward")), ("bsbolt", {"YS": ("Z", "W_G2A")}, 0, ("forward", "reverse")),
    ("bsmap", {"ZS": ("Z", "+-")}, 0, ("forward", "reverse")), ("dnmtools", {"CV": ("A", "A")}, 16, ("forward", "reverse")),
    ("hisat-3n", {"YZ": ("A", "-")}, 0, ("reverse", "forward")), ("merantk", {"YG": ("Z", "G2A"), "YR": ("Z", "C2T")}, 0, ("reverse", "reverse")),
    ("unconverted", {}, 16, ("forward", "reverse")), ("directional", {}, 144, ("forward", "reverse")),
])
def test_strand_rules(spark, rule, tags, flags, expected):
    row = spark.createDataFrame([(0, "r", flags, "g", 0, 60, "4M", "ACGT", None, tags)], plain.READS)
    got = strand.rule(rule).call(row).first()
    assert (got.original, got.aligned) == expected


def test_strand_rule_errors(spark):
    row = spark.createDataFrame([(0, "r7", 0, "g", 0, 60, "4M", "ACGT", None, {})], plain.READS)
    with pytest.raises(Exception, match="0 keys hold for read r7"):
        strand.rule("bismark").call(row).collect()
    negated = strand.StrandRule.parse('[strand.original]\nforward = \'not XG == "GA"\'\n[strand.aligned]\nforward = "TRUE"')
    assert negated.call(row).first().conv_strand == "OT"
    for bad in ('forward = "is_odd"', 'forward = "XG == CT"', 'forward = "is_reverse or"', 'forward = "(is_reverse"', 'sideways = "true"'):
        with pytest.raises(ValueError):
            strand.StrandRule.parse(f'[strand.original]\n{bad}\n[strand.aligned]\nforward = "true"')
    with pytest.raises(ValueError, match="same condition"):
        strand.StrandRule.parse('[strand.original]\nforward = "true"\nreverse = "true"\n[strand.aligned]\nforward = "true"')


def test_codes():
    assert K.name_of(K.codeset("{NJ}")) == "{NJ}" and K.char_of(K.codeset("{N.}")) == "*" and K.complement(K.code_of("R")) == K.code_of("Y")


@pytest.mark.parametrize("bad", [
    '[query.a]\nread = "CC"\nrefr = "C"', '[query.a]\nread = "C"\nrefr = "C"\nwhere = "not a"', '[query.a]\nread = "C"\nrefr = "C"\nwhere = "b"',
    '[query.a]\nread = "c"\nrefr = "C"', '[query.a]\nread = "{A,C}"\nrefr = "C"', '[query.a]\nread = "="\nrefr = "."', '[query.a]\nread = "C2"\nrefr = "CC"',
    '[query.a]\nread = "C"\nrefr = "C"\nmark = "++"', '[query.a]\nread = "C"\nrefr = "C"\nextra = 1', '[alias]\nAB = "C"', '[query.a]\nread = "C"\nrefr = "C"\nwhere = "a and"',
])
def test_rejects(bad):
    with pytest.raises(patterns.QueryError):
        patterns.load(bad)


def test_shipped_queries():
    assert list(patterns.load(patterns.methyldackel()).queries) == list(patterns.CONTEXT_CALLS)
    marks = patterns.load(patterns.bismark())
    assert sorted(marks.queries) == sorted(patterns.CALL_LETTERS) and marks.max_span == 11
    q = marks.queries["Z"]
    assert q.anchor_refr == "C" and not q.anchor_can_lack_base


@pytest.mark.parametrize("seed", [1, 2])
def test_shipped_context_calls(spark, seed):
    """Against contexts read off the genome; alignments without gaps."""
    refs = {k: v.replace("N", "G") for k, v in plain.genomes(seed).items()}
    rows = [x for x in plain.records(seed, refs, 40, "M") if all(op != "S" for op, _ in x[4])]
    queries = patterns.load(patterns.methyldackel())
    steps = hits.steps_for(queries)
    out = hits.hit_rows(walked(spark, rows, refs, steps), queries, steps).collect()
    other = str.maketrans("ACGT", "TGCA")
    for i, (_, flags, contig, pos, ops, seq) in enumerate(rows):
        expected, genome = [], refs[contig]
        for k, b in enumerate(seq):
            p = pos + k
            c = genome[p - 2 : p + 1][::-1].translate(other) if plain.bottom(flags) else genome[p : p + 3]
            b = b.translate(other) if plain.bottom(flags) else b
            if c[:1] == "C" and len(c) == 3 and b in "CT":
                expected.append(({True: "CpG", False: "CHG" if c[2] == "G" else "CHH"}[c[1] == "G"] + ("_methylated" if b == "C" else "_unmethylated"), p))
        assert sorted((r.name, r.refr_pos) for r in out if r.record_id == i) == sorted(expected)


def test_discordance(spark):
    steps = walk.Steps(0, 0)
    reads = walked(spark, [("r", 0, "g", 0, [("M", 8)], "AAGTTCTT")], {"g": "AAGTCCGG"}, steps, "unconverted")
    assert hits.concordance(reads, steps).first() == (8, 2)
    with pytest.raises(ValueError, match="2 of 8"):
        hits.assert_concordant(reads, steps, 0.2, 1)
