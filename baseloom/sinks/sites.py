"""Per-site output formats.

Each has a function that gives the rows of a file as a DataFrame, in the file's column
order, and ``write_rows`` stores one.  Ties that formats leave open are broken by
strand and relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.functions.columns import pos0, pos1
from baseloom.functions.numbers import fixed, general15, half_even, like_python
from baseloom.operators.evidence import block_summary

TRINUCLEOTIDE = "^C[ACGT]{2}$"


def _pooled(sites: DataFrame, relation: str | None, keys: list[str], min_depth: int) -> DataFrame:
    rows = sites if relation is None else sites.filter(F.col("relation") == relation)
    sums = rows.groupBy(*keys).agg(F.sum("num").cast("bigint").alias("num"), F.sum("den").cast("bigint").alias("den"))
    return sums.filter(F.col("den") >= min_depth)


def _percent():
    return F.lit(100.0) * F.col("num") / F.nullif("den", F.lit(0))


def bedgraph(sites: DataFrame, relation: str, min_depth: int = 1, base: int = 0) -> DataFrame:
    rows = _pooled(sites, relation, ["contig", "refr_pos"], min_depth).orderBy("contig", "refr_pos")
    at = pos0(F.col("refr_pos"), base)
    return rows.select("contig", at.alias("start"), (at + 1).alias("end"), general15(_percent()).alias("percent"))


def bismark_cov(sites: DataFrame, relation: str, min_depth: int = 1, base: int = 0) -> DataFrame:
    rows = _pooled(sites, relation, ["contig", "refr_pos"], min_depth).orderBy("contig", "refr_pos")
    at = pos1(F.col("refr_pos"), base)
    return rows.select("contig", at.alias("start"), at.alias("end"), general15(_percent()).alias("percent"), F.col("num").alias("methylated"), (F.col("den") - F.col("num")).alias("unmethylated"))


def methyldackel_bedgraph(sites: DataFrame, relation: str, min_depth: int = 1, base: int = 0) -> DataFrame:
    rows = _pooled(sites, relation, ["contig", "refr_pos"], min_depth).orderBy("contig", "refr_pos")
    at = pos0(F.col("refr_pos"), base)
    return rows.select("contig", at.alias("start"), (at + 1).alias("end"), F.floor(_percent()).cast("int").alias("percent"), F.col("num").alias("methylated"), (F.col("den") - F.col("num")).alias("unmethylated"))


def bedmethyl(sites: DataFrame, relation: str, min_depth: int = 1, base: int = 0) -> DataFrame:
    rows = _pooled(sites, relation, ["contig", "refr_pos", "strand"], min_depth).orderBy("contig", "refr_pos", "strand")
    at = pos0(F.col("refr_pos"), base)
    return rows.select(
        "contig", at.alias("start"), (at + 1).alias("end"), F.lit(relation).alias("name"), F.least("den", F.lit(1000)).alias("score"), "strand",
        at.alias("thickStart"), (at + 1).alias("thickEnd"), F.lit("0,0,0").alias("itemRgb"), F.col("den").alias("coverage"), fixed(_percent(), 2).alias("percent"),
    )


def cgmap(sites: DataFrame, relations, min_depth: int = 1, base: int = 0) -> DataFrame:
    """Relations named by a trinucleotide; it is an error if none of the declared ones is."""
    import re

    if not any(re.match(TRINUCLEOTIDE, r) for r in relations):
        raise ValueError("CGmap takes its context from relations named CAA to CTT, and none is declared")
    rows = _pooled(sites.filter(F.col("relation").rlike(TRINUCLEOTIDE)), None, ["contig", "refr_pos", "strand", "relation"], min_depth).orderBy("contig", "refr_pos", "strand", "relation")
    level = half_even(F.col("num") * 1.0 / F.nullif("den", F.lit(0)), 2)
    second, third = (F.substring("relation", k, 1) == "G" for k in (2, 3))
    return rows.select(
        "contig", F.when(F.col("strand") == "+", "C").when(F.col("strand") == "-", "G").alias("nucleotide"), pos1(F.col("refr_pos"), base).alias("pos"),
        F.when(second, "CG").when(third, "CHG").otherwise("CHH").alias("class"), F.substring("relation", 1, 2).alias("dinucleotide"),
        like_python(level).alias("level"), F.col("num").alias("mC"), F.col("den").alias("total"),
    )


def cellinfo(sites: DataFrame, cg_relation: str, ch_relation: str, min_sites: int = 0) -> DataFrame:
    def of(relation: str, column: str):
        return F.sum(F.when(F.col("relation") == relation, F.col(column)))

    def percent(relation: str):
        return fixed(100.0 * of(relation, "num") / F.nullif(of(relation, "den"), F.lit(0)), 2)

    rows = block_summary(sites).groupBy("block").agg(
        F.sum("den").alias("all_calls"), of(cg_relation, "sites").alias("cg_cov"), percent(cg_relation).alias("cg_pct"),
        of(ch_relation, "sites").alias("ch_cov"), percent(ch_relation).alias("ch_pct"),
    )
    return rows.filter(F.coalesce("cg_cov", F.lit(0)) >= min_sites).orderBy("block")


def sites_parquet(sites: DataFrame) -> DataFrame:
    return sites.filter("den > 0").orderBy("block", "contig", "refr_pos", "relation", "strand")


def amethyst(sites: DataFrame, relation: str, contigs: DataFrame, base: int = 0) -> DataFrame:
    """(block, chr, pos, c, t) in order of block, contig file and position.

    contigs: (name, i).  A site on a contig that it hasn't is an error, raised when the
    rows are read.
    """
    rows = sites.filter((F.col("relation") == relation) & (F.col("den") > 0)).join(F.broadcast(contigs.select(F.col("name").alias("contig"), "i")), "contig", "left")
    order = F.coalesce("i", F.raise_error(F.concat(F.lit("contig without a place in the contig order: "), "contig")).cast("bigint"))
    rows = rows.withColumn("i", order).orderBy("block", "i", "refr_pos", "strand")
    return rows.select("block", F.col("contig").alias("chr"), pos1(F.col("refr_pos"), base).alias("pos"), F.col("num").alias("c"), (F.col("den") - F.col("num")).alias("t"))


FORMATS = {"bedgraph": bedgraph, "bismark_cov": bismark_cov, "methyldackel_bedgraph": methyldackel_bedgraph, "bedmethyl": bedmethyl, "cgmap": cgmap, "cellinfo": cellinfo, "sites_parquet": sites_parquet, "amethyst": amethyst}


def write_rows(rows: DataFrame, path: str, single: bool = False, compression: str | None = None) -> None:
    """Tab-separated text without a header, in parts whose names are in the rows' order; ``single`` joins them to one."""
    out = rows.write.mode("overwrite").option("sep", "\t").option("header", "false").option("emptyValue", "").option("nullValue", "")
    (out.option("compression", compression) if compression else out).csv(path)
    if single:
        join_parts(rows.sparkSession, path)


def join_parts(spark: SparkSession, path: str) -> None:
    """Makes one file of a folder's part files, in the order of their names; bytes are streamed, rows aren't sorted again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    parts = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    if len(parts) < 2:
        return
    whole = jvm.org.apache.hadoop.fs.Path(folder, "_joined")
    sink = fs.create(whole, True)
    for part in parts:
        source = fs.open(part)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, sink, conf, False)
        source.close()
    sink.close()
    for part in parts:
        fs.delete(part, False)
    fs.rename(whole, parts[0])


def write_parquet(rows: DataFrame, path: str, compression: str = "snappy", partition_by: list[str] | None = None) -> None:
    out = rows.write.mode("overwrite").option("compression", compression)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_amethyst(rows: DataFrame, path: str, context: str) -> None:
    """A folder per context and block with chr, pos, c and t in order: what an HDF5 reader calls /context/block/1.

    Overwrites the context's folders alone.
    """
    place = [c for c in ("i", "chr", "pos") if c in rows.columns]
    ordered = rows.repartitionByRange("block", *place).sortWithinPartitions("block", *place)
    ordered.write.mode("overwrite").partitionBy("block").parquet(f"{path}/context={context}")
