import hashlib
import re

from pyspark.sql import functions as F

from baseloom.llm import exact_dedup as E
from baseloom.llm._scratch import Scratch


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        group = [j for j, u in norm if u == t]
        out.append((i, min(group), len(group), i == min(group), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark, docs_of, clashing):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, "A b"), (2, None), (4, ""), (7, " "), (8, "\n \r"), (6, "x" * 300_000), (10, "x" * 300_000), (11, "é\x0b\x0cü"), (12, "é ü"), (13, "a b")]
    got = E.exact_dedup(clashing(docs_of(rows)))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_ties_and_emptiness(spark, docs_of):
    got = E.exact_dedup(docs_of([(1, "a"), (1, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert E.exact_dedup(docs_of([("x", "y")][:0])).count() == 0


def test_runs_compact_and_look_up(spark, docs_of):
    index = E.DigestIndex(Scratch(spark))
    for part in ([(4, "a"), (2, "b")], [(3, "a"), (9, "c")]):
        index.flush(docs_of(part).select("doc_id", E.digest(F.col("text")).alias("digest")))
    a = hashlib.sha256(b"a").digest()
    before = index.lookup([a]).first()
    index.compact()
    assert len(index.runs) == 1 and before == index.lookup([a]).first() and (before.doc_id, before.n) == (3, 2)


def test_filter_has_all_hits_and_few_others(spark):
    hits = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"))
    others = spark.range(4000, 44000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"))
    known = E.HitFilter(hits)
    assert known.probe(hits).filter("NOT maybe").count() == 0 and known.probe(others).filter("maybe").count() < 0.1 * 40000
    assert E.HitFilter(hits.limit(0)).probe(others).filter("maybe").count() == 0


def test_equal_digests_of_unequal_texts_part(spark, docs_of, monkeypatch):
    rows = docs_of([(1, "a"), (2, "b"), (3, "a")]).select("doc_id", "text")
    found = spark.createDataFrame([(i, b"d", 1, 3) for i in (1, 2, 3)], "doc_id bigint, digest binary, keep_id bigint, group_size bigint")
    clashes = spark.createDataFrame([(b"d",)], "digest binary")
    monkeypatch.setattr(E, "digest", lambda text: F.lit(b"d"))
    got = E._by_bytes(rows, found, clashes).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]
