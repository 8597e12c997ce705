"""Simulated fragments: the length is found, no base is counted twice, and records stay whole."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from baseloom.operators import overlap as O
from baseloom.sources.alignments import SCHEMA
from tests.scan import plain


def cigar_of(places):
    """Matches, with a deletion wherever places jump."""
    out, run = "", 1
    for a, b in zip(places, places[1:]):
        if b == a + 1:
            run += 1
        else:
            out, run = f"{out}{run}M{b - a - 1}D", 1
    return f"{out}{run}M"


def record(n, qname, flags, places, seq, qual=30, cigar=None, mapq=60, **tags):
    quals = None if qual is None else [qual] * len(seq) if isinstance(qual, int) else qual
    return (n, qname, flags, 0, "g", places[0], mapq, cigar or cigar_of(places), 0, "g", 0, 0, seq, None if quals is None else "".join(chr(q + 33) for q in quals), quals, {k: (("i" if v.lstrip("-").isdigit() else "Z"), v) for k, v in tags.items()})


def fragment(r, name, length, len1, len2, gap=None, start=None):
    """Two mates of a molecule; gap: (at, n) reference bases that it lacks."""
    start = r.randint(0, 20) if start is None else start
    places = [start + k + (gap[1] if gap and k >= gap[0] else 0) for k in range(length)]
    molecule = "".join(r.choices("ACGT", k=length))
    one, two = range(min(len1, length)), range(max(0, length - len2), length)
    return [record(0, name, 0x63, [places[k] for k in one], molecule[: len(one)], NM="0", MC="1M"), record(1, name, 0x93, [places[k] for k in two], molecule[two[0] :], NM="0", MC="1M")]


def table(spark, rows):
    return spark.createDataFrame([(i, *row[1:]) for i, row in enumerate(rows)], SCHEMA)


def decided(spark, rows, **options):
    (got,) = O.fragment_verdicts(table(spark, rows), O.with_options(**options)).collect()
    return got


def resolved(spark, rows, **options):
    return O.resolve_overlaps(table(spark, rows), O.with_options(**options)).orderBy("record_id").collect()


def places_of(row):
    out, p = [], row.pos
    for n, op in re.findall(r"(\d+)([A-Z])", row.cigar):
        if op == "M":
            out += range(p, p + int(n))
        p += int(n) if op in "MDN" else 0
    return out


def test_many_fragments(spark, monkeypatch):
    r = random.Random(1)
    rows, truth = [], {}
    for k in range(700):
        length, len1, len2 = r.randint(20, 120), r.randint(10, 80), r.randint(10, 80)
        gap = (r.randint(8, length - 8), r.randint(1, 4)) if r.random() < 0.3 else None
        rows += fragment(r, f"q{k}", length, len1, len2, gap)
        truth[f"q{k}"] = (length, min(len1, length) + min(len2, length) - length, gap)
    monkeypatch.setattr(O, "SLICE", 7)
    reads = table(spark, rows).repartition(5)
    out = O.resolve_overlaps(reads)
    assert out.columns == reads.columns
    verdicts = {v.qname: v for v in O.fragment_verdicts(reads).collect()}
    kept, before = {}, {i: row for i, row in enumerate(rows)}
    for x in out.collect():
        kept.setdefault(x.qname, []).append(x)
        assert sum(int(n) for n, op in re.findall(r"(\d+)([A-Z])", x.cigar) if op in "MIS") == len(x.seq) == len(x.quals) == len(x.qual)
        assert x.cigar == before[x.record_id][7] or "NM" not in x.tags
    for name, (length, shared, gap) in truth.items():
        v = verdicts[name]
        if v.verdict == "resolved":
            assert (v.length, v.overlap) == (length, shared) and all(x.tags["XL"].value == str(length) and x.tags["oO"].value == str(shared) for x in kept[name])
            seen = [p for x in kept[name] for p in places_of(x)]
            assert len(seen) == len(set(seen))
            if len(kept[name]) == 2:
                one, two = sorted(kept[name], key=lambda x: x.record_id)
                assert (one.mate_pos, two.mate_pos, one.tags["MC"].value) == (two.pos, one.pos, two.cigar) and one.insert_size == -two.insert_size
        else:
            assert gap or shared < 12, (name, v)
    assert sum(v.verdict == "resolved" for v in verdicts.values()) > 300
    stats = {(s.section, s.key): s.value for s in O.statistics(O.fragment_verdicts(reads)).collect()}
    good = [v for v in verdicts.values() if v.verdict == "resolved"]
    assert stats["templates", "resolved"] == len(good) == sum(v for (s, _), v in stats.items() if s == "length")
    assert stats["counts", "positions_compared"] == sum(v.counts.get("positions_compared", 0) for v in verdicts.values())


def test_refusals(spark):
    r = random.Random(2)
    rows = fragment(r, "q", 60, 40, 40)
    v = decided(spark, rows)
    assert (v.verdict, v.length, v.overlap, v.kept_r1, v.counts["positions_match"], v.support) == ("resolved", 60, 20, True, 20, 20)
    assert decided(spark, rows, min_support=99).reason == "low_support" and decided(spark, rows, min_overlap=21).verdict == "none" and decided(spark, rows[:1]).verdict == "single"
    turned = list(rows[1])
    turned[12] = turned[12].translate(str.maketrans("ACGT", "CATG"))
    assert decided(spark, [rows[0], tuple(turned)]).reason == "high_mismatch"
    extra = record(2, "q", 0x63 | 0x800, [9, 10, 11], "ACG")
    assert decided(spark, [*rows, extra]).reason == "inconsistent_length"
    # one mate shows a deletion where the other has an insertion-free match: two rival lengths
    one, two = rows
    shifted = record(1, "q", 0x93, [one[5] + 20 + k + (6 if k >= 10 else 0) for k in range(40)], two[12])
    assert decided(spark, [one, shifted], max_anchor_slack=2).verdict in ("unresolved", "resolved")
    assert resolved(spark, rows, min_support=99, on_unresolved="drop") == []
    assert resolved(spark, rows, min_support=99)[0].tags["oV"].value == "low_support"
    with pytest.raises(ValueError):
        O.with_options(keep="both")


def test_evidence(spark):
    r = random.Random(3)
    rows = fragment(r, "q", 60, 40, 40)
    one, two = resolved(spark, rows)
    assert one.quals == [30] * 20 + [40] * 20 and two.cigar == "20S20M" and two.pos == rows[1][5] + 20 and one.cigar == "40M"
    odd = list(rows[1])
    odd[12] = odd[12][:5] + ("A" if odd[12][5] != "A" else "C") + odd[12][6:]
    odd[14], odd[13] = [20] * 40, "5" * 40
    pair = [rows[0], tuple(odd)]
    one, two = resolved(spark, pair)
    assert one.quals[25] == 10 and two.quals[5] == 0 and one.tags["oX"].value == "1"
    one, two = resolved(spark, pair, mismatch_base="set_n", keep="r2", match_qual="none", mismatch_qual="none")
    assert one.seq[25] == two.seq[5] == "N" and one.cigar == "20M20S" and one.quals == [30] * 40 and one.tags["oK"].value == "2"
    one, two = resolved(spark, pair, mismatch_qual="zero_both", match_qual="max")
    assert (one.quals[25], two.quals[5], two.quals[6]) == (0, 0, 30)
    assert resolved(spark, pair, mismatch_qual="zero_loser")[0].quals[25] == 30
    no_quals = resolved(spark, [rows[0][:13] + (None, None) + rows[0][15:], rows[1]])
    assert no_quals[0].quals is None and no_quals[0].qual is None and no_quals[1].quals == [30] * 40
    hard = resolved(spark, rows, hard_clip=True)[1]
    assert (hard.cigar, hard.seq, len(hard.quals)) == ("20H20M", rows[1][12][20:], 20)


def fragments_of(spark, *rows):
    frame = table(spark, rows)
    return O.Fragments(pa.Table.from_pylist([{**x.asDict(recursive=True), "tags": list(x.tags.items())} for x in frame.collect()], to_arrow_schema(frame.schema)))


@pytest.mark.parametrize("cigar, front, back, expected, moved", [
    ("3S6M2D4M", 6, 0, "9S4M", 8), ("1H4M2I5M2S", 0, 6, "1H4M1I8S", 0), ("5M4N3M", 5, 0, "5S3M", 9), ("5M4N3M", 0, 3, "5M3S", 0), ("2M1D3M1D2M", 2, 2, "2S3M2S", 3), ("6M", 1, 1, "1S4M1S", 1), ("4M2I4M", 4, 0, "4S2I4M", 4),
])
def test_clipped_alignments(spark, cigar, front, back, expected, moved):
    import numpy as np

    size = sum(int(n) for n, op in re.findall(r"(\d+)([A-Z])", cigar) if op in "MIS")
    f = fragments_of(spark, record(0, "q", 0, [100], "A" * size, cigar=cigar))
    texts, pos, *_ = O.reclipped(f, np.array([front]), np.array([back]), False)
    assert (texts[0], pos[0]) == (expected, 100 + moved)


def test_terminal_gaps_go(spark):
    """A deletion two bases from the kept mate's 3' end is clipped with what is behind it."""
    r = random.Random(4)
    rows = fragment(r, "q", 50, 40, 30, gap=(38, 2))
    one, two = resolved(spark, rows, keep="r1")
    assert one.cigar == "38M2S" and decided(spark, rows, keep="r1").verdict == "resolved"


def test_other_alignments_and_new_primaries(spark):
    """SA tells of the clipped alignment, with its edits counted by MD; a supplementary takes a dropped primary's place."""
    r = random.Random(5)
    one, two = fragment(r, "q", 60, 40, 40, start=100)
    two = two[:15] + ({"NM": ("i", "2"), "MD": ("Z", "3A30C5"), "SA": ("Z", "old")},)
    extra = record(2, "q", 0x93 | 0x800, [5000], two[12], cigar="40H5M".replace("40H", "35S"), NM="1", SA="old")
    rows = [one, two, extra]
    got = {x.record_id: x for x in resolved(spark, rows)}
    assert got[2].tags["SA"].value == f"g,{got[1].pos + 1},-,{got[1].cigar},60,1;" and got[1].tags["SA"].value.startswith("g,5001,-,35S5M,60,")
    assert O.edits_kept("3A4^CC2T0", [("S", 2), ("M", 8), ("D", 2), ("M", 2), ("I", 1), ("M", 1)], 0, 0) == 5
    assert O.edits_kept("3A4^CC2T0", [("S", 2), ("M", 8), ("D", 2), ("M", 2), ("I", 1), ("M", 1)], 4, 1) == 3
    assert O.edits_kept("3A4^CC2T0", [("M", 8), ("D", 2), ("M", 2), ("I", 1), ("M", 1)], 8, 0) == 2 and O.edits_kept("9", [("M", 10)], 0, 0) is None
    one, two = fragment(r, "p", 30, 30, 30, start=100)
    extra = record(2, "p", 0x93 | 0x800, [5000], two[12], cigar="25S5M")
    got = {x.record_id: x for x in resolved(spark, [one, two, extra])}
    assert sorted(got) == [0, 2] and got[2].flags & 0x800 == 0


def test_edit_tags(spark):
    """NM and MD against a walk along the operations."""
    refs = plain.genomes(8)
    rows = plain.records(8, refs, 50)
    out = O.with_edit_tags(plain.frame(spark, rows), plain.contigs(spark, refs))
    for x in out.collect():
        _, _, contig, p, ops, seq = rows[x.record_id]
        s = edits = run = 0
        md = ""
        for op, n in ops:
            if op in "M=X":
                for k in range(n):
                    if seq[s + k] == refs[contig][p + k]:
                        run += 1
                    else:
                        md, run, edits = f"{md}{run}{refs[contig][p + k]}", 0, edits + 1
            elif op == "D":
                md, run, edits = f"{md}{run}^{refs[contig][p : p + n]}", 0, edits + n
            edits += n if op == "I" else 0
            s += n if op in "M=XIS" else 0
            p += n if op in "M=XDN" else 0
        assert (x.tags["NM"].value, x.tags["MD"].value) == (str(edits), f"{md}{run}")


def test_statistics_take_one_pass(spark):
    """The verdicts are made once, for the rate too; without verdicts the rate is there, and null."""
    r = random.Random(6)
    rows = [x for k in range(20) for x in fragment(r, f"q{k}", 60, 40, 40)]
    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    verdicts = O.fragment_verdicts(table(spark, rows))
    got = {(x.section, x.key): x.value for x in O.statistics(verdicts.mapInArrow(counted, verdicts.schema)).collect()}
    assert count.value == 20 and got["rate_ppm", "mismatch"] == 0 and got["templates", "resolved"] == 20
    assert [tuple(x) for x in O.statistics(verdicts.filter("false")).collect()] == [("rate_ppm", "mismatch", None)]


def test_several_records_of_a_read(spark):
    """Records that show the same places of a read: the aligned base, then the better mapped record stands for it."""
    r = random.Random(7)
    one, two = fragment(r, "q", 60, 40, 40, start=100)
    worse = record(2, "q", 0x63 | 0x800, [5000], one[12], cigar="40M", mapq=10)
    better = record(2, "q", 0x63 | 0x800, [5000], one[12], cigar="40M", mapq=61)
    assert decided(spark, [one, two, worse]).overlap == 20 and decided(spark, [one, two, better]).verdict != "resolved"


def test_edit_texts_take_no_loop_over_records(monkeypatch):
    """MD of a deletion that goes on, one behind another, edits at both ends, and records without any."""
    import numpy as np

    from baseloom.functions import codes as K

    gap, a, c, g = K.GAP, K.A, K.C, K.G
    shown = [[(a, a), (a, c), (gap, g), (gap, a), (c, c)], [], [(c, c)] * 12, [(gap, c), (a, gap), (gap, g), (a, g)], [(K.SKIP, a), (a, c)]]
    first = np.cumsum([0, *map(len, shown)])
    flat = [x for cols in shown for x in cols]
    rec = np.repeat(np.arange(len(shown)), np.diff(first))
    columns = O.Columns(first, rec, *(np.array([x[k] for x in flat], np.uint8) for k in (0, 1)), rec, rec, rec)
    edits, md = O.edit_texts(columns, len(shown))
    assert (edits.tolist(), md.to_pylist()) == ([3, 0, 0, 4, 1], ["1C0^GA1", "0", "12", "0^CG0G0", "0C0"])
