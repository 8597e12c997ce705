"""Queries of the scanning operators, over sequences made of documents.

A document's letters are a contig of bases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.functions import codes as K
from baseloom.operators import overlap, partition, strand, verify, walk
from baseloom.plans.bridges import hits as line_hits
from baseloom.plans.bridges import table
from baseloom.plans.reads import REF, columns_sql, contigs, reads

QUERIES: dict = {}


def _add(name: str, sql: str | None):
    def take(function):
        QUERIES[name] = (function, sql)
        return function

    return take


@_add("cigar_geometry", """SELECT doc_id AS record_id, (10 + doc_id % 5 + n) AS end_pos, (10 - doc_id % 3 - 2) AS unclipped_start, (10 + doc_id % 5 + n + doc_id % 4 + 1) AS unclipped_end,
  CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 2 END AS hard_clip_5p, CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 0 END AS hard_clip_3p,
  CASE WHEN doc_id % 2 = 1 THEN doc_id % 4 + 1 ELSE doc_id % 3 END AS soft_clip_5p, CASE WHEN doc_id % 2 = 1 THEN doc_id % 3 ELSE doc_id % 4 + 1 END AS soft_clip_3p
FROM (SELECT doc_id, n_chars AS n FROM documents)""")
def cigar_geometry(spark, d):
    s = lambda c: c.cast("string")
    i = F.col("doc_id")
    lead = F.when(i % 3 > 0, F.concat(s(i % 3), F.lit("S"))).otherwise("")
    cigar = F.concat(F.lit("2H"), lead, s(F.col("n_chars")), F.lit("M"), F.when(i % 5 > 0, F.concat(s(i % 5), F.lit("D"))).otherwise(""), F.lit("1I"), s(i % 4 + 1), F.lit("S"))
    rows = table(spark, d, "documents").select(i.alias("record_id"), F.when(i % 2 == 1, 16).otherwise(0).alias("flags"), F.lit(10).cast("bigint").alias("pos"), cigar.alias("cigar"))
    return walk.with_geometry(rows).select("record_id", "end_pos", "unclipped_start", "unclipped_end", "hard_clip_5p", "hard_clip_3p", "soft_clip_5p", "soft_clip_3p")


@_add("strand_call", """WITH r AS (SELECT l_linenumber % 2 = 1 AS rev, l_suppkey % 2 = 1 AS last FROM lineitem)
SELECT CASE WHEN rev = last THEN CASE WHEN rev THEN 'CTOT' ELSE 'OT' END ELSE CASE WHEN rev THEN 'OB' ELSE 'CTOB' END END AS conv_strand, CASE WHEN rev = last THEN '+' ELSE '-' END AS strand, rev <> last AS walk_reversed, last AS mirrors_read, count(*) AS n FROM r GROUP BY ALL""")
def strand_call(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("q").alias("qname"), ((F.col("l_linenumber") % 2) * 16 + (F.col("l_suppkey") % 2) * 128).cast("int").alias("flags"), F.create_map().cast("map<string,struct<type:string,value:string>>").alias("tags"))
    return strand.rule("directional").call(rows).groupBy("conv_strand", "strand", "walk_reversed", "mirrors_read").agg(F.count("*").alias("n"))


_FLAG_SQL = ", ".join(f"(f & {bit}) <> 0 AS {name}" for name, bit in strand.FLAGS.items())


@_add("record_fields", f"""WITH r AS (SELECT l_orderkey % 4096 AS f, l_suppkey, l_partkey, l_linenumber, l_orderkey, l_quantity FROM lineitem), w AS (SELECT *, l_partkey % 7 + 4 AS m, (f & 16) <> 0 AS rev FROM r)
SELECT l_orderkey * 8 + l_linenumber AS record_id, 'q' || l_orderkey AS qname, 'c' || l_suppkey % 3 AS ref_name, '2H3S' || m || 'M1S' AS cigar, 'c0' AS mate_ref_name, repeat('A', m + 4) AS seq_ascii, repeat('I', m + 4) AS qual_phred, f AS flags,
  (l_quantity)::SMALLINT AS mapq, (l_suppkey % 3)::INT AS tid, CASE WHEN l_linenumber % 2 = 0 THEN 0 END AS mate_tid, l_partkey AS pos, l_partkey + m AS end_pos, l_partkey - 5 AS unclipped_start, l_partkey + m + 1 AS unclipped_end, m + 4 AS read_len,
  CASE WHEN rev THEN 0 ELSE 2 END AS hard_clip_5p, CASE WHEN rev THEN 2 ELSE 0 END AS hard_clip_3p, CASE WHEN rev THEN 1 ELSE 3 END AS soft_clip_5p, CASE WHEN rev THEN 3 ELSE 1 END AS soft_clip_3p, -l_partkey AS insert_size, l_partkey + 1 AS mate_pos, {_FLAG_SQL},
  CASE WHEN rev = ((f & 128) <> 0) THEN '+' ELSE '-' END AS strand, CASE WHEN rev THEN CASE WHEN (f & 128) <> 0 THEN 'CTOT' ELSE 'OB' END ELSE CASE WHEN (f & 128) <> 0 THEN 'CTOB' ELSE 'OT' END END AS conv_strand, rev AS read_reverse,
  CASE WHEN l_suppkey % 3 > 0 THEN l_partkey END AS "NM", CASE WHEN l_suppkey % 3 > 0 THEN l_partkey::DOUBLE END AS "XF", CASE WHEN l_suppkey % 3 = 0 THEN 'x' END AS "XZ" FROM w""")
def record_fields(spark, d):
    """All fields of a record, and tags as whole numbers, floats and text."""
    from baseloom.operators.records import FIELDS, with_fields

    m, one = F.col("l_partkey") % 7 + 4, F.col("l_suppkey") % 3 == 0
    entry = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    value = F.when(one, entry("Z", F.lit("x"))).otherwise(entry("i", F.col("l_partkey")))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    reads = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_id"), text("q", F.col("l_orderkey")).alias("qname"), (F.col("l_orderkey") % 4096).cast("int").alias("flags"), (F.col("l_suppkey") % 3).cast("int").alias("tid"),
        text("c", F.col("l_suppkey") % 3).alias("ref_name"), F.col("l_partkey").alias("pos"), F.col("l_quantity").cast("smallint").alias("mapq"), text("2H3S", m, "M1S").alias("cigar"), F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(-1).alias("mate_tid"),
        F.lit("c0").alias("mate_ref_name"), (F.col("l_partkey") + 1).alias("mate_pos"), (-F.col("l_partkey")).alias("insert_size"), F.repeat(F.lit("A"), (m + 4).cast("int")).alias("seq"), F.repeat(F.lit("I"), (m + 4).cast("int")).alias("qual"), F.create_map(*(x for k in ("NM", "XF", "XZ") for x in (F.lit(k), value))).alias("tags"),
    )
    out = walk.with_geometry(strand.rule("directional").call(reads))
    wanted = [*FIELDS, "NM:i", "XF:f", "XZ:Z"]
    return with_fields(out, wanted).select("record_id", *(f.partition(":")[0] for f in wanted))


def fragment_reads(spark: SparkSession, d: str) -> DataFrame:
    """Mates of fragments: two thirds of a contig from either end, so that all overlap."""
    base = contigs(spark, d).select("doc_id", "contig", F.col("length").cast("int").alias("n"), "seq")
    mates = base.withColumn("m", F.col("n") - F.floor(F.col("n") / 3).cast("int")).withColumn("mate", F.explode(F.array(F.lit(0), F.lit(1))))
    first = F.col("mate") == 0
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    start = F.when(first, F.lit(0)).otherwise(F.col("n") - F.col("m"))
    columns = {
        "record_id": F.col("doc_id") * 2 + F.col("mate"), "qname": text("f", F.col("doc_id")), "tid": F.col("doc_id").cast("int"), "ref_name": F.col("contig"), "flags": F.when(first, 0x63).otherwise(0x93),
        "pos": start.cast("bigint"), "mapq": F.lit(60).cast("smallint"), "cigar": F.concat(F.col("m").cast("string"), F.lit("M")), "mate_tid": F.col("doc_id").cast("int"), "mate_ref_name": F.col("contig"),
        "mate_pos": F.lit(0).cast("bigint"), "insert_size": F.lit(0).cast("bigint"), "seq": F.substr("seq", start + 1, F.col("m")), "qual": F.repeat(F.lit("?"), F.col("m")),
        "quals": F.array_repeat(F.lit(30), F.col("m")), "tags": F.create_map().cast("map<string,struct<type:string,value:string>>"),
    }
    return mates.select(*(c.alias(k) for k, c in columns.items()))


_SPAN = f"""WITH {REF}, f AS (SELECT doc_id, length(seq) AS n, length(seq) - length(seq) // 3 AS m FROM ref), o AS (SELECT *, 2 * m - n AS shared FROM f),
d AS (SELECT *, shared >= 4 AS good, shared = m AS whole FROM o)"""


@_add("overlap_length", f"""{_SPAN} SELECT 'f' || doc_id AS qname, CASE WHEN good THEN n ELSE 0 END::INT AS length, CASE WHEN good THEN shared ELSE 0 END::INT AS overlap, CASE WHEN good THEN 'resolved' ELSE 'none' END AS verdict FROM d""")
def overlap_length(spark, d):
    out = overlap.fragment_verdicts(fragment_reads(spark, d))
    return out.select("qname", F.when(F.col("verdict") == "resolved", F.col("length")).otherwise(0).alias("length"), "overlap", "verdict")


@_add("overlap_clipped", f"""{_SPAN} SELECT doc_id * 2 AS record_id, m::BIGINT AS kept, 0 AS pos, CASE WHEN good THEN sha256(repeat('?', n - m) || repeat('I', shared)) ELSE sha256(repeat('?', m)) END AS qualities FROM d
UNION ALL SELECT doc_id * 2 + 1, m - CASE WHEN good THEN shared ELSE 0 END, n - m + CASE WHEN good THEN shared ELSE 0 END, CASE WHEN good THEN sha256(repeat('I', shared) || repeat('?', n - m)) ELSE sha256(repeat('?', m)) END FROM d WHERE NOT (good AND whole)""")
def overlap_clipped(spark, d):
    """Aligned bases that each record keeps, where they start, and merged qualities; a mate that is all overlap goes."""
    out = overlap.resolve_overlaps(fragment_reads(spark, d))
    kept = F.aggregate(walk.cigar_ops(F.col("cigar")), F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["op"] == "M", x["n"]).otherwise(F.lit(0)))
    return out.select("record_id", kept.alias("kept"), F.col("pos").cast("int").alias("pos"), F.sha2("qual", 256).alias("qualities"))


@_add("overlap_statistics", f"""{_SPAN}, c AS (SELECT 'counts' AS section, key, sum(value)::BIGINT AS value FROM (
  SELECT unnest(['positions_compared', 'positions_match', 'quals_raised', 'bases_clipped', 'records_dropped']) AS key, unnest([shared, shared, 2 * shared, CASE WHEN whole THEN 0 ELSE shared END, whole::INT]) AS value FROM d WHERE good) GROUP BY key)
SELECT * FROM c WHERE value > 0 UNION ALL SELECT 'templates', CASE WHEN good THEN 'resolved' ELSE 'none' END AS key, count(*) AS value FROM d GROUP BY ALL
UNION ALL SELECT 'length', n::VARCHAR, count(*) FROM d WHERE good GROUP BY ALL UNION ALL SELECT 'overlap', shared::VARCHAR, count(*) FROM d WHERE good GROUP BY ALL
UNION ALL SELECT 'rate_ppm', 'mismatch', CASE WHEN sum(shared) FILTER (good) > 0 THEN 0 END FROM d""")
def overlap_statistics(spark, d):
    return overlap.statistics(overlap.fragment_verdicts(fragment_reads(spark, d)))


@_add("overlap_tags", f"""{_SPAN}, r AS (SELECT *, unnest([0, 1]) AS mate FROM d)
SELECT doc_id * 2 + mate AS record_id, CASE WHEN good THEN n::VARCHAR END AS xl, CASE WHEN good THEN shared ELSE 0 END::VARCHAR AS o, CASE WHEN good THEN shared::VARCHAR END AS support, CASE WHEN good THEN '1' END AS kept,
  CASE WHEN good THEN shared::VARCHAR END AS changed FROM r WHERE NOT (good AND whole AND mate = 1)""")
def overlap_tags(spark, d):
    """What is written beside each record: length, overlap, support, the kept mate, and how many qualities are new."""
    tag = lambda k: F.col("tags")[k]["value"]
    out = overlap.resolve_overlaps(fragment_reads(spark, d))
    return out.select("record_id", tag("XL").alias("xl"), tag("oO").alias("o"), tag("oN").alias("support"), tag("oK").alias("kept"), tag("ov").alias("changed"))


@_add("overlap_mates", f"""{_SPAN} SELECT doc_id * 2 AS record_id, CASE WHEN good AND NOT whole THEN n - m + shared ELSE 0 END::BIGINT AS mate_pos, CASE WHEN good AND NOT whole THEN n - (n = 1)::INT ELSE 0 END::BIGINT AS insert_size FROM d WHERE NOT (good AND whole)
UNION ALL SELECT doc_id * 2 + 1, 0, CASE WHEN good AND NOT whole THEN -n ELSE 0 END FROM d WHERE NOT (good AND whole)""")
def overlap_mates(spark, d):
    """Mate position and template length of mates that both stay."""
    out = overlap.resolve_overlaps(fragment_reads(spark, d))
    both = out.groupBy("qname").agg(F.count("*").alias("c")).filter("c = 2")
    return out.join(both, "qname", "left_semi").select("record_id", "mate_pos", "insert_size")


@_add("edit_tags", f"""WITH {columns_sql(None, True)}, e AS (SELECT rid, op, pos, CASE WHEN back THEN translate(rf, 'ACGT', 'TGCA') ELSE rf END AS c, op IN ('I', 'D') OR (op = 'M' AND rd <> rf) AS edit FROM cols)
SELECT rid AS record_id, count(*) FILTER (edit) AS nm, coalesce(string_agg(c, '' ORDER BY pos) FILTER (edit AND op <> 'I'), '') AS letters FROM e GROUP BY rid""")
def edit_tags(spark, d):
    """NM, and the reference's letters in MD."""
    out = overlap.with_edit_tags(reads(spark, d).select("record_id", "flags", "ref_name", "pos", "cigar", "seq", "quals", "tags"), contigs(spark, d))
    return out.select("record_id", F.col("tags")["NM"]["value"].cast("bigint").alias("nm"), F.regexp_replace(F.col("tags")["MD"]["value"], "[^A-Z]", "").alias("letters"))


@_add("contig_check", """SELECT coalesce(c, r) AS contig, CASE WHEN r IS NULL THEN 'absent' WHEN c IS NULL THEN 'unused' ELSE 'ok' END AS status
FROM (SELECT DISTINCT 'chr' || CAST(1 + l_suppkey % 5 AS VARCHAR) AS c FROM lineitem) FULL JOIN (SELECT 'chr' || CAST(n_nationkey + 3 AS VARCHAR) AS r FROM nation) ON c = r""")
def contig_check(spark, d):
    refs = table(spark, d, "nation").select(F.concat(F.lit("chr"), (F.col("n_nationkey") + 3).cast("string")).alias("contig"), F.lit(1).cast("bigint").alias("length"))
    return verify.contig_check(line_hits(spark, d), refs)


#: All bases of all contigs, c on the strand that a contig's number names.
_CHARS = f"""{REF}, chars AS (SELECT doc_id, length(seq) AS len, unnest(range(length(seq))) AS i, unnest(string_split(CASE WHEN doc_id % 2 = 1 THEN translate(seq, 'ACGT', 'TGCA') ELSE seq END, '')) AS c FROM ref)"""


@_add("shift_check", f"""WITH {_CHARS}, s AS (SELECT h.*, shift FROM (SELECT * FROM chars WHERE c = 'C') h, unnest([0, -1, 1, -2, 2]) AS t(shift))
SELECT shift, count(*) AS checked, count(*) FILTER (x.c = 'C') AS matched FROM s LEFT JOIN chars x ON x.doc_id = s.doc_id AND x.i = s.i + shift GROUP BY shift""")
def shift_check(spark, d):
    one = contigs(spark, d)
    back = F.col("doc_id") % 2 == 1
    letter = F.when(back, "G").otherwise("C")
    rows = one.select("contig", F.when(back, "-").otherwise("+").alias("strand"), letter.alias("letter"), F.posexplode(F.split("seq", "")).alias("i", "b")).filter("b = letter")
    hits = rows.select("contig", F.col("i").cast("bigint").alias("refr_pos"), F.lit("C").alias("refr_base"), "strand")
    return verify.shift_check(hits, one)


@_add("fasta_md5", f"WITH {REF} SELECT contig, length(seq) AS length, md5(seq) AS md5 FROM ref")
def fasta_md5(spark, d):
    return contigs(spark, d).select("contig", "length", F.md5(F.upper("seq").cast("binary")).alias("md5"))


_CODES = """(SELECT code, n, CASE WHEN code & 1 > 0 THEN 8 ELSE 0 END + CASE WHEN code & 8 > 0 THEN 1 ELSE 0 END + CASE WHEN code & 2 > 0 THEN 4 ELSE 0 END + CASE WHEN code & 4 > 0 THEN 2 ELSE 0 END + (code & 240) AS complement,
  CASE WHEN code & 15 > 0 THEN substr('?ACMGRSVTWYHKDBN', (code & 15) + 1, 1) ELSE '' END || CASE WHEN code & 16 > 0 THEN '.' ELSE '' END || CASE WHEN code & 32 > 0 THEN '_' ELSE '' END || CASE WHEN code & 64 > 0 THEN ':' ELSE '' END || CASE WHEN code & 128 > 0 THEN ',' ELSE '' END AS parts
  FROM (SELECT CAST(l_partkey % 256 AS INT) AS code, count(*) AS n FROM lineitem GROUP BY ALL))"""


@_add("codesets", f"""SELECT code, complement, CASE WHEN code = 0 THEN '0' WHEN code = 255 THEN '~' WHEN length(parts) = 1 THEN parts ELSE '{{' || replace(parts, ',', 'J') || '}}' END AS name, n FROM {_CODES}""")
def codesets(spark, d):
    """Complements and names of all codesets."""
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 256).cast("int").alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n")).select("code", K.complemented(F.col("code")).alias("complement"), K.named(F.col("code")).alias("name"), "n")


@_add("shards", """WITH names AS (SELECT 'r' || CAST(l_orderkey % 3000 AS VARCHAR) AS qname, count(*) AS n FROM lineitem GROUP BY ALL),
hashed AS (SELECT *, list_reduce([14695981039346656037::HUGEINT] || list_transform(string_split(qname, ''), lambda c: ascii(c)::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM names)
SELECT CAST(h % 16 AS INT) AS shard, count(*) AS fragments, sum(n)::BIGINT AS hits FROM hashed GROUP BY ALL""")
def shards(spark, d):
    out = partition.with_shards(line_hits(spark, d), 16)
    return out.groupBy("shard").agg(F.count_distinct("qname").alias("fragments"), F.count("*").alias("hits"))
