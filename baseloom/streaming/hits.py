"""Counts over hits that keep coming: the counting operators on a streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.operators.evidence import SITE, source
from baseloom.operators.measures import Measure, Relation, side_table


def stream_hits(spark: SparkSession, path: str, schema: str, max_files: int | None = None, **names) -> DataFrame:
    """Hit files as they appear in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return source(reader.parquet(path), **names)


def site_counts(hits: DataFrame, measures: list[Measure], relations: list[Relation] | None = None) -> DataFrame:
    """num and den of each site and relation so far; for complete or update mode."""
    relations = relations or [m.relate() for m in measures if len(m.categories) == 2]
    sides = F.broadcast(side_table(hits.sparkSession, relations))
    return hits.join(sides, "name").groupBy(*SITE, "relation").agg(F.sum("main").cast("bigint").alias("num"), F.sum("side").cast("bigint").alias("den"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Rows by window of event time and keys; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
