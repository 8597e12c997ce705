import gzip

import pytest
from pyspark.sql import functions as F

from baseloom.sources import alignments as A
from baseloom.sources import manifest as M
from baseloom.sources import reference as R

SAM = "\n".join([
    "@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:40\tM5:abc", "@SQ\tSN:chr2\tLN:9", "@CO\tnote",
    "a\t99\tchr1\t3\t60\t2S3M\t=\t9\t20\tACGTN\tIIII#\tNM:i:1\tXG:Z:C:T\tNM:i:9\tYD:A:f\tFL:f:1.5\tBB:B:i,1,2",
    "b\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*", "c\t16\tchr2\t1\t7\t4M\tchr1\t1\t0\t*\t*",
]) + "\n"


@pytest.fixture
def sam(tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    return str(tmp_path / "x.sam")


def test_sam(spark, sam):
    a, b, c = A.read_sam(spark, sam).orderBy("record_id").collect()
    assert (a.record_id, a.qname, a.flags, a.tid, a.ref_name, a.pos, a.mapq, a.cigar, a.mate_ref_name, a.mate_pos, a.insert_size) == (0, "a", 99, 0, "chr1", 2, 60, "2S3M", "chr1", 8, 20)
    assert a.quals == [40, 40, 40, 40, 2] and a.tags["NM"].value == "1" and a.tags["XG"].value == "C:T" and a.tags["FL"].type == "f"
    assert (b.ref_name, b.tid, b.quals, b.tags) == (None, -1, None, {}) and (c.seq, c.mate_tid, c.pos) == ("*", 0, 0)
    assert A.contigs(A.header(spark, sam)) == [("chr1", 40, "abc"), ("chr2", 9, None)]


def test_sam_round_trip(spark, sam, tmp_path):
    reads = A.read_sam(spark, sam)
    header = A.with_program(A.header(spark, sam), "baseloom", "1", "scan x")
    A.write_sam(reads.repartition(3), str(tmp_path / "out"), header)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x for x in lines if x[0] == "@"] == [*SAM.splitlines()[:4], "@PG\tID:baseloom\tPN:baseloom\tVN:1\tCL:scan x"]
    assert A.read_sam(spark, str(tmp_path / "out")).orderBy("record_id").collect() == reads.orderBy("record_id").collect()
    A.write_sam(reads.repartition(3), str(tmp_path / "one"), header, single=True)
    (part,) = (p for p in (tmp_path / "one").iterdir() if p.name.startswith("part-"))
    text = part.read_text().splitlines()
    assert text[:5] == header.splitlines() and text[6:] == SAM.splitlines()[5:] and text[5].startswith("a\t99\tchr1\t3\t60\t2S3M\t=\t9\t20\tACGTN\tIIII#\tNM:i:1\tXG:Z:C:T")
    again = A.with_program(header, "baseloom", "1")
    assert again.splitlines()[-1] == "@PG\tID:baseloom.1\tPN:baseloom\tVN:1\tPP:baseloom"


def test_lines_are_numbered_over_files(spark, tmp_path):
    lines = [f"r{i}\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*" for i in range(3000)]
    for k in range(3):
        (tmp_path / f"f{k}.sam").write_text("@HD\tVN:1.6\n" + "\n".join(lines[1000 * k : 1000 * k + 1000]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 7000)
    try:
        got = A.read_sam(spark, str(tmp_path / "*.sam")).select("record_id", "qname").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.record_id, r.qname) for r in got) == [(i, f"r{i}") for i in range(3000)]


def test_bam_equals_sam(spark, sam, tmp_path):
    reads, header = A.read_sam(spark, sam), A.header(spark, sam)
    path = str(tmp_path / "x.bam")
    A.write_bam(reads.repartition(2), path, header)
    rows, got = (x.orderBy("record_id").collect() for x in (reads, A.read_bam(spark, path)))
    for r, g in zip(rows, got, strict=True):
        assert [g[c] for c in r.asDict() if c != "tags"] == [r[c] for c in r.asDict() if c != "tags"]
    assert {k: v.value for k, v in got[0].tags.items()} == {"NM": "1", "XG": "C:T", "YD": "f", "FL": "1.5", "BB": "1,2"}
    assert A.bam_start(path)[0].rstrip() == header and [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
    spark.dataSource.register(A.BamSource)
    assert sorted(r.qname for r in spark.read.format("bam").load(path).select("qname").collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="BGZF"):
        list(A.bgzf_blocks(b"nothing like it"))
    assert A.aux_tags(b"NMC\x05XXZab") == {"NM": ("C", "5")}


def test_bam_splits(spark, tmp_path):
    """Records that straddle blocks and splits come once, with dense numbers over files, whatever the splits."""
    import random

    r = random.Random(3)
    header = A.header_of([("c", 10_000, None), ("d", 90, "m")])
    counts = (4000, 1, 0, 2500)
    for k, n in enumerate(counts):
        rows = []
        for i in range(n):
            size = r.choice([0, 5, 80, 150, 3000]) if i % 500 else 90_000
            seq = "".join(r.choices("ACGT", k=size))
            rows.append((i, f"f{k}r{i}", 4 if i % 3 else 0, i % 2, "cd"[i % 2], i, 7, f"{size}M" if size else "*", -1, None, -1, 0, seq or "*", "?" * size or None, [30] * size or None, {"XX": ("Z", "x" * r.randint(0, 40)), "NM": ("i", str(i))}))
        A.write_bam(spark.createDataFrame(rows, A.SCHEMA).repartition(3), str(tmp_path / f"f{k}.bam"), header)
    expected = [f"f{k}r{i}" for k, n in enumerate(counts) for i in range(n)]
    for split in (50_000, 200_000, 1 << 30):
        splits, _ = A.counted_splits(spark, A.bam_paths(str(tmp_path)), split)
        out = A.read_bam(spark, str(tmp_path), split=split).select("record_id", "qname", F.col("tags")["NM"]["value"].alias("nm"), F.length("seq").alias("n")).orderBy("record_id").collect()
        assert [x.qname for x in out] == expected and [x.record_id for x in out] == list(range(len(expected)))
        assert all(x.qname.endswith(f"r{x.nm}") for x in out) and (split > 1e6 or len(splits) > 5)


def test_fasta(spark, tmp_path):
    text = ">chr1 first\nACGTn\nACGT\n>chr2\n;comment\nRYk\r\n>empty\n"
    (tmp_path / "x.fa").write_text(text)
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(text)
    for name in ("x.fa", "x.fa.gz"):
        got = R.read_fasta(spark, str(tmp_path / name)).orderBy("i").collect()
        assert [(r.contig, r.i, r.length, r.seq) for r in got] == [("chr1", 0, 9, "ACGTnACGT"), ("chr2", 1, 3, "RYk"), ("empty", 2, 0, "")]
    (tmp_path / "m5.fa").write_text(">a\nacgt\n")
    assert R.read_fasta(spark, str(tmp_path / "m5.fa")).first().md5 == "f1f8f4bf413b16ad135722aa4591043e"
    for bad in (">a\nAC1T\n", ">a\nAC\n>a\nGT\n", "> x\nAC\n", "ACGT\n>a\nAC\n"):
        (tmp_path / "bad.fa").write_text(bad)
        with pytest.raises(R.ReferenceError_):
            R.read_fasta(spark, str(tmp_path / "bad.fa"))


def test_contigs(spark):
    refs = spark.createDataFrame([("chr2", 0, 9, "d9", ""), ("chr1", 1, 40, "abc", "")], "contig string, i int, length bigint, md5 string, seq string")
    assert R.resolve_contigs([("chr1", 40, "ABC"), ("other", 5, None), ("chr2", 9, None)], refs) == ({0: 1, 2: 0}, 1)
    for own in ([("chr1", 41, None)], [("chr1", 40, "xyz")], [("chrX", 1, None)]):
        with pytest.raises(R.ReferenceError_):
            R.resolve_contigs(own, refs)


def test_small_tables(spark, tmp_path):
    (tmp_path / "x.fai").write_text("chr2\t5\t0\t1\t2\nchr10\t7\t0\t1\t2\nchr1\t9\n")
    assert [(r.name, r.length, r.i) for r in R.read_contig_order(spark, str(tmp_path / "x.fai")).orderBy("i").collect()] == [("chr2", 5, 0), ("chr10", 7, 1), ("chr1", 9, 2)]
    (tmp_path / "x.bed").write_text("chr1\t3\t9\tname\t0\t+\nchr2\t0\t1\n")
    assert sorted(map(tuple, R.read_bed(spark, str(tmp_path / "x.bed")).collect())) == [("chr1", 3, 9), ("chr2", 0, 1)]
    (tmp_path / "names").write_text("a\nb\n\n")
    assert [r.qname for r in R.read_names(spark, str(tmp_path / "names")).collect()] == ["a", "b"]


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("CG", 5)], "name string, refr_pos bigint")
    query = '[query.CG]\nread = "C"\nrefr = "C"'
    path = str(tmp_path / "hits")
    M.write_hits(rows, path, query, threads=3)
    got = M.read_manifest(spark, path)
    assert got["coordinate_base"] == 0 and got["threads"] == 3 and M.query_names(got) == ["CG"]
    assert M.read_hits(spark, path).collect() == rows.collect()
    with pytest.raises(Exception, match="manifest"):
        M.read_hits(spark, str(tmp_path / "none"))
    text = 'a = "tab\there"\n\n[b]\nc = "\\\\"'
    head = "\n".join(["@HD\tVN:1.6", *M.comment_lines("q.toml", text, "r1"), "@CO\tother", *M.comment_lines("s.toml", "x", "r2")])
    assert M.stored_files(head) == [("r1", "q.toml", text), ("r2", "s.toml", "x")]
    with pytest.raises(ValueError, match="of 4 lines"):
        M.stored_files("\n".join(head.splitlines()[:3]))
