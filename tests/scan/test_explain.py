"""Texts about queries, made-up columns, and counts of a scan."""

import pytest
from pyspark.sql import functions as F

from baseloom.functions import codes as K
from baseloom.operators import explain, hits, patterns, strand
from tests.scan import plain

TEXT = '[pattern.here]\nread = "CN"\nrefr = "C~"\n[pattern.there]\nread = "~="\nrefr = "~G"\n[query.both]\nwhere = "here and not there"\nmark = "+^"'


def test_terse_patterns():
    assert explain.terse("C~3@CG~2") == patterns.parse_pattern("C~~~", "CG~~") and explain.terse("{CT}2@N2") == patterns.parse_pattern("{CT}{CT}", "NN")
    assert explain.marked(".3+") == (3, (3,), 4)
    for bad in ("CG", "C+@CG", "2C@CC", "C0@C", "C2@C"):
        with pytest.raises(patterns.QueryError):
            explain.terse(bad)


def test_explanations():
    queries = patterns.load(TEXT)
    text = explain.explained(queries)
    assert text.startswith("both: 2 columns, anchored at column 0 on reference C, capturing columns 0, 1")
    assert "\nhere   read  C  N\n" in text and "there  read  ~  =" in text and "both   mark  +  ^" in text and text.splitlines()[-4:] == ["  and", "    here", "    not", "      there"]
    codes = {symbol: code for symbol, _, code in explain.code_list()}
    assert codes["R"] == K.code_of("A") | K.code_of("G") and codes["."] == K.GAP and codes["~"] == K.ANY and len(codes) == 20


def test_traces():
    queries = patterns.load(TEXT)
    assert explain.columns_of_text("CAC2@CG{NJ}T") == ([K.C, K.A, K.C, K.C], [K.C, K.G, K.codeset("{NJ}"), K.T])
    read, refr = explain.columns_of_text("CGC2@CGCT")
    lines = explain.traced(queries, read, refr).splitlines()
    assert lines[:2] == ["read C G C C", "refr C G C T"] and "both at 0: no hit" in lines and "  there: yes" in lines and "both at 2: hit" in lines
    assert "  here: no, column 0: read G isn't in C and reference G isn't in C" in lines and "  there: no, column 1: reference T isn't in G" in lines
    for bad in ("CC@C", "@", "{C@C"):
        with pytest.raises(patterns.QueryError):
            explain.columns_of_text(bad)


def test_scan_counts(spark):
    refs = plain.genomes(9)
    frame = plain.frame(spark, plain.records(9, refs, 40)).withColumn("flags", F.when(F.col("record_id") % 10 == 3, 4).otherwise(F.col("flags"))).withColumn("seq", F.when(F.col("record_id") == 5, "*").otherwise(F.col("seq")))
    queries = patterns.load('[query.kept]\nread = "C"\nrefr = "C"\n[query.turned]\nread = "T"\nrefr = "C"')
    rows, counts = hits.observed_scan(frame, plain.contigs(spark, refs), queries, strand.rule("directional"), fields=["qname"])
    found = rows.collect()
    told = counts()
    assert (told["records"], told["unmapped"], told["no_seq"], told["walkable"], told["off_reference"]) == (40, 4, 1, 35, 0)
    assert told["hits"] == len(found) == told["hits_kept"] + told["hits_turned"] > 0
    assert sorted(map(str, found)) == sorted(map(str, hits.scan(frame, plain.contigs(spark, refs), queries, strand.rule("directional"), fields=["qname"]).collect()))
    assert hits.report_text(told).splitlines()[:2] == ["records\t40", "unknown strand\t0"]
