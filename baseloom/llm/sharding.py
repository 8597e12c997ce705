"""Consistent placement on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: it starts
at its own offset and advances by its own step.  Shards take turns; each claims the
next slot of its order that is free.  The table has a fixed size, so it is broadcast,
and placing a row is one hash and one lookup.  Adding or removing a shard moves few
other slots, and no shard has over one slot more than another.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots, of which there is a prime number, at least; and for each shard, so that shares differ by under 1 %.
SLOTS, SLOTS_A_SHARD = 65537, 128
SHARDS = 64


def slots_for(shards: int) -> int:
    """The least prime that is enough."""
    n = max(SLOTS, SLOTS_A_SHARD * shards) | 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not 0 < len(shards) <= slots:
        raise ValueError("there must be 1 shard at least and no more shards than slots")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A null key counts as the empty string."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key_col: str = "doc_id", shards: int | list[str] = SHARDS, slots: int | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """All rows and columns, with the slot and the shard's name; slots must be a prime, by default one for the number of shards.

    Rows with equal keys share a shard; rows with a null key go where the empty
    string goes.  Columns of the input that have the names of the two new ones are
    replaced.  An empty table stays empty, with the new columns.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    slots = slots or slots_for(len(names))
    owner = lookup_table(names, slots)
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, names[k]) for i, k in enumerate(owner)], f"`{slot_col}` int, `{shard_col}` string")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (slot_col, shard_col)), slot(F.col(f"`{key_col}`"), slots).alias(slot_col))
    return kept.join(F.broadcast(table), slot_col).select(*(c for c in kept.columns if c != slot_col), slot_col, shard_col)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")))
