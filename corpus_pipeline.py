"""A training-data pipeline over ``documents``: STAGES run one after another.

Quality classifier, n-gram Jaccard join, benchmark decontamination, mixing sources to
target weights, sharding.  Each stage gets what its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from baseloom.llm import decontam, jaccard_join, mixing, quality, sharding
from baseloom.llm._scratch import Scratch


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.  Null texts score as empty ones; ids are whole numbers or null."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id, a null one first; texts without words all stay, and of equal rows one."""
    return jaccard_join.near_dedup(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is, within a few words, an item of the benchmark; null and empty texts and items have none."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times; null sources are one source, texts without words have no size."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard, which take the place of columns of these names; a null id is placed as the empty text is."""
    return sharding.place(docs)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]
#: A classifier is trained on the way, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
