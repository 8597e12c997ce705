"""Exact deduplication with a log-structured merge index of digests.

A task is a memtable: it sorts the digests of its rows and flushes them as a run, a
Parquet file with a Bloom filter and min/max statistics on the digest.  Compaction
merges runs into one row per digest, with its smallest identifier and its count.
Digests counted more than once are hits, and a filter of their hashes, of bounded size,
is broadcast.  Rows that miss it are alone and done; only the others are looked up in
the compacted run, and only their texts are shuffled, for the byte verification.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.llm._hot import join_hot
from baseloom.llm._scratch import Scratch

#: One run of blanks counts as one space.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Sorted runs of (digest, doc_id, n) in the shared folder, n rows with doc_id as their smallest.

    ``flush`` adds a run for each task, ``compact`` merges all runs, ``lookup`` finds
    digests; its filter on a digest reaches the files' Bloom filters.
    """

    OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.runs: list[DataFrame] = []

    def flush(self, digests: DataFrame) -> DataFrame:
        """digests: rows of (digest, doc_id)."""
        rows = digests.select("digest", "doc_id", F.lit(1).cast("bigint").alias("n"))
        self.runs.append(self.scratch.write(rows.sortWithinPartitions("digest", "doc_id"), **self.OPTIONS))
        return self.runs[-1]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))

    def compact(self) -> DataFrame:
        """All runs as one, which takes their place in the index; their tables stay."""
        self.runs = [self.scratch.write(self._merged(self.runs).sortWithinPartitions("digest"), **self.OPTIONS)]
        return self.runs[0]

    def lookup(self, digests: list[bytes]) -> DataFrame:
        return self._merged([run.filter(F.col("digest").isin(digests)) for run in self.runs])


class HitFilter:
    """A bit for each digest that several rows have: 16 bits a digest, 16 MB at most; more digests only make more false hits."""

    MOST_BITS = 1 << 27

    def __init__(self, hits: DataFrame):
        wanted = 16 * hits.count()
        self.bits = 1 << min(max(15, wanted.bit_length()), self.MOST_BITS.bit_length() - 1)
        spot = self._spot(F.col("digest"))
        table = hits.groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_bitmap"))
        self.table = F.broadcast(table)

    def _spot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits)) + 1

    def probe(self, rows: DataFrame) -> DataFrame:
        """rows, which have a digest, with ``maybe``: false where the digest is of no hit."""
        spot = self._spot(F.col("digest"))
        at = F.bitmap_bit_position(spot)
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), at.bitwiseAND(F.lit(7)).cast("int") + 1)
        bit = F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))
        return rows.join(self.table, F.bitmap_bucket_number(spot) == F.col("_bucket"), "left").withColumn("maybe", bit).drop("_bucket", "_bitmap")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal each other.  Of equal texts the
    row with the smallest id stays; rows that share both text and id can't be told
    apart and all stay.  A null id is larger than any other; in a group of null ids
    only, keep_id is null and all stay.  Columns beside the two named are ignored.
    An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    index = DigestIndex(scratch)
    log = index.flush(rows.select("doc_id", digest(F.col("text")).alias("digest")))
    hits = index.compact().filter("n > 1")
    known = HitFilter(hits)
    total = log.count()

    seen = known.probe(log.select("doc_id", "digest"))
    single = seen.filter("NOT maybe").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    found = join_hot(
        seen.filter("maybe").select("doc_id", "digest"),
        hits.select("digest", F.col("doc_id").alias("least"), F.col("n").alias("group_size"), "n"), ["digest"], "n", total, "left",
    )
    found = found.select("doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    found = single.unionByName(found)

    texts = rows.select(normalised(F.col("text")).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    classes = known.probe(texts).filter("maybe").groupBy("digest", "norm").agg(F.lit(1).alias("one"))
    clashes = scratch.write(classes.groupBy("digest").count().filter("count > 1").select("digest"))
    if not clashes.isEmpty():
        found = _by_bytes(rows, found, clashes)
    return found.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _by_bytes(rows: DataFrame, found: DataFrame, clashes: DataFrame) -> DataFrame:
    """Regroups by the text itself what shares a digest without being equal."""
    odd = rows.select("doc_id", normalised(F.col("text")).alias("norm"), digest(F.col("text")).alias("digest")).join(clashes, "digest", "left_semi")
    groups = odd.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    split = odd.join(groups, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size")
    return found.join(clashes, "digest", "left_anti").select(*split.columns).unionByName(split)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)
"""
