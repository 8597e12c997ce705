"""References: FASTA files as tables of contigs, and how alignments' contigs map to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.functions.codes import IUPAC


class ReferenceError_(ValueError):
    pass


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, i, length, md5, seq), i in file order; plain or gzip (BGZF too).

    A contig's name is the first word of its header.  Names that are empty or come twice,
    letters that aren't IUPAC, and sequence before a header are errors.  Lines with a
    semicolon in front are comments.  The checksum is that of SAM's M5.
    """
    records = spark.read.text(path, lineSep=">").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    if records.groupBy("file").agg(F.min_by("value", "at").alias("v")).filter(F.length(F.trim("v")) > 0).take(1):
        raise ReferenceError_("sequence before the first header")
    rows = records.withColumn("lines", F.split(F.regexp_replace("value", "\r", ""), "\n"))
    name = F.regexp_extract(F.get("lines", F.lit(0)), r"^(\S+)", 1)
    body = F.filter(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: ~x.startswith(";"))
    rows = rows.filter(F.length(F.trim("value")) > 0).select("file", "at", name.alias("contig"), F.regexp_replace(F.array_join(body, ""), r"\s", "").alias("seq"), F.col("value").startswith(" ").alias("nameless"))
    wrong = (F.col("contig") == "") | F.col("nameless") | ~F.col("seq").rlike(f"^[{IUPAC[1:]}Uu{IUPAC[1:].lower()}]*$")
    bad = rows.filter(wrong).select("contig").take(1)
    if bad:
        raise ReferenceError_(f"contig {bad[0][0]!r}: no name, or letters that aren't IUPAC")
    twice = rows.groupBy("contig").count().filter("count > 1").take(1)
    if twice:
        raise ReferenceError_(f"two contigs are named {twice[0][0]!r}")
    order = {r.contig: i for i, r in enumerate(rows.select("contig", "file", "at").orderBy("file", "at").collect())}
    table = F.create_map(*(x for n, i in order.items() for x in (F.lit(n), F.lit(i)))) if order else F.create_map().cast("map<string,int>")
    upper = F.upper("seq")
    return rows.select("contig", F.try_element_at(table, F.col("contig")).alias("i"), F.length("seq").cast("bigint").alias("length"), F.md5(upper.cast("binary")).alias("md5"), "seq")


def fetch(seq: Column, length: Column, start: Column, stop: Column) -> Column:
    """Bases from start to stop, ``_`` off the contig."""
    lo, hi = F.greatest(start, F.lit(0)), F.least(stop, length)
    body = F.substr(seq, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    return F.rpad(F.concat(F.repeat(F.lit("_"), F.least(lo - start, stop - start).cast("int")), body), (stop - start).cast("int"), F.lit("_"))


def resolve_contigs(own: list[tuple[str, int, str | None]], refs: DataFrame) -> tuple[dict[int, int], int]:
    """({place in the alignment's header: place in the reference}, number of those not found).

    Contigs map by name; another length or checksum is an error, as is no shared contig.
    """
    known = {r.contig: r for r in refs.select("contig", "i", "length", "md5").collect()}
    out = {}
    for k, (name, length, m5) in enumerate(own):
        if name not in known:
            continue
        r = known[name]
        if r.length != length:
            raise ReferenceError_(f"{name} has {length} bases in the alignments and {r.length} in the reference")
        if m5 and m5.lower() != r.md5:
            raise ReferenceError_(f"{name} has checksum {m5} in the alignments and {r.md5} in the reference")
        out[k] = r.i
    if own and not out:
        raise ReferenceError_("the alignments and the reference share no contig")
    return out, len(own) - len(out)


def read_contig_order(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, i) of a .fai or .genome file, i in file order."""
    rows = [line.value.split("\t") for line in spark.read.text(path).coalesce(1).collect() if line.value.strip()]
    if any(len(r) < 2 for r in rows):
        raise ReferenceError_("a contig file has a name and a length on each line")
    return spark.createDataFrame([(r[0], int(r[1]), i) for i, r in enumerate(rows)], "name string, length bigint, i bigint")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end), 0-based and half-open; further columns are ignored."""
    return spark.read.csv(path, sep="\t", comment="#", schema="contig string, start bigint, end bigint").filter("start IS NOT NULL")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(qname), one on each line."""
    return spark.read.text(path).select(F.col("value").alias("qname")).filter("qname <> ''")
