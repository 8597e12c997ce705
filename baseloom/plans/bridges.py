"""Views of the driver's tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.operators.measures import Measure

MCG = Measure("mCG", methylated="CG", unmethylated="TG")
MCH = Measure("mCH", methylated="CHH", unmethylated=["THH", "THG"])
#: Relations named by trinucleotides, for CGmap.
TRI = [Measure("CGA", methylated="CG", unmethylated="TG"), Measure("CAG", methylated="CHH", unmethylated="THG"), Measure("CAA", methylated="CHH", unmethylated="THH")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits made of line items."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), (F.col("l_orderkey") % 3000).cast("string")).alias("qname"),
        (F.col("l_linenumber") % 2 == 1).alias("mate"),
        F.concat(F.lit("b"), (F.col("l_suppkey") % 8).cast("string")).alias("cell"),
        F.when(F.col("l_returnflag") == "A", "CG").when(F.col("l_returnflag") == "N", "TG").when(F.col("l_linenumber") % 3 == 0, "CHH").when(F.col("l_linenumber") % 3 == 1, "THH").otherwise("THG").alias("name"),
        F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 5).cast("string")).alias("contig"),
        F.col("l_partkey").alias("refr_pos"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.col("l_quantity").cast("int").alias("qual"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions made of parts; some overlap."""
    parts = table(spark, sf_dir, "part")
    return parts.select(F.concat(F.lit("chr"), (1 + F.col("p_size") % 5).cast("string")).alias("contig"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + 1 + F.col("p_size") % 3).alias("end"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of reads, made of customers with orders; many are of no read."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") * 3).cast("string")).alias("qname"))


SQL = """
src AS (
  SELECT {'qname': qname, 'mate': mate} AS read, * FROM (
    SELECT 'r' || CAST(l_orderkey % 3000 AS VARCHAR) AS qname, l_linenumber % 2 = 1 AS mate,
      'b' || CAST(l_suppkey % 8 AS VARCHAR) AS block,
      CASE WHEN l_returnflag = 'A' THEN 'CG' WHEN l_returnflag = 'N' THEN 'TG'
           WHEN l_linenumber % 3 = 0 THEN 'CHH' WHEN l_linenumber % 3 = 1 THEN 'THH' ELSE 'THG' END AS name,
      'chr' || CAST(1 + l_suppkey % 5 AS VARCHAR) AS contig, l_partkey AS refr_pos,
      CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, CAST(l_quantity AS INT) AS qual
    FROM lineitem)),
measure(measure, name, category) AS (VALUES
  ('mCG', 'CG', 'methylated'), ('mCG', 'TG', 'unmethylated'),
  ('mCH', 'CHH', 'methylated'), ('mCH', 'THH', 'unmethylated'), ('mCH', 'THG', 'unmethylated')),
sided AS (SELECT *, measure AS relation, (category = 'methylated')::INT AS main FROM measure),
read_relation AS (SELECT read, relation, sum(main)::BIGINT AS num, count(*)::BIGINT AS den FROM src JOIN sided USING (name) GROUP BY ALL),
block_relation AS (SELECT block, relation, sum(main)::BIGINT AS num, count(*)::BIGINT AS den FROM src JOIN sided USING (name) GROUP BY ALL),
block_extent AS (SELECT block, relation, count(DISTINCT read) AS reads, count(DISTINCT (contig, refr_pos, strand)) AS sites FROM src JOIN sided USING (name) GROUP BY ALL),
calls AS (SELECT DISTINCT read, refr_pos, main FROM src JOIN sided USING (name) WHERE relation = 'mCH'),
isl AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY refr_pos, main) - row_number() OVER (PARTITION BY read, main ORDER BY refr_pos, main) AS island FROM calls),
runs AS (SELECT read, island, count(*) AS run FROM isl WHERE main = 1 GROUP BY ALL),
bad_reads AS (SELECT read FROM read_relation WHERE relation = 'mCH' AND den >= 3 AND num::DOUBLE / den > 0.6),
bad_blocks AS (SELECT block FROM block_extent WHERE relation = 'mCG' AND reads < 940),
resolved AS (SELECT * FROM src WHERE read NOT IN (SELECT read FROM bad_reads)),
site_stranded AS (SELECT block, contig, refr_pos, strand, measure, category, count(*) AS n FROM resolved JOIN measure USING (name) GROUP BY ALL),
site_category AS (
  SELECT block, contig, CASE WHEN measure = 'mCG' AND strand = '-' THEN refr_pos - 1 ELSE refr_pos END AS refr_pos,
    CASE WHEN measure = 'mCG' THEN '+' ELSE strand END AS strand, measure, category, sum(n)::BIGINT AS n
  FROM site_stranded GROUP BY ALL),
site_all AS (
  SELECT block, contig, refr_pos, strand, measure AS relation,
    coalesce(sum(n) FILTER (category = 'methylated'), 0)::BIGINT AS num, sum(n)::BIGINT AS den
  FROM site_category GROUP BY ALL),
regions AS (SELECT 'chr' || CAST(1 + p_size % 5 AS VARCHAR) AS contig, p_partkey AS lo, p_partkey + 1 + p_size % 3 AS hi FROM part),
pooled AS (SELECT contig, refr_pos, sum(num)::BIGINT AS num, sum(den)::BIGINT AS den FROM site_all WHERE relation = 'mCG' GROUP BY ALL)
"""
