"""Shards: a fixed hash of record fields, so that a key's records stay together."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the 64-bit FNV-1a hash.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = ((h ^ b) * PRIME) & (2**64 - 1)
    return h


def fnv1a_column(text: Column) -> Column:
    """The same over a string's UTF-8 bytes, as a signed bigint (the same 64 bits)."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    hexed = F.hex(text.cast("binary"))
    places = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("bigint")
    # a product modulo 2**64 without overflow: the prime is 2**40 + 435
    def step(h: Column, i: Column) -> Column:
        x = h.bitwiseXOR(byte(i))
        low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
        product = low * 435
        upper = F.shiftleft((high * 435).bitwiseAND(F.lit(0xFFFFFFFF)), 32)
        return _wrap(_wrap(product, upper), F.shiftleft(x, 40))

    return F.aggregate(places, F.lit(signed(OFFSET)).cast("bigint"), step)


def _wrap(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, in two halves."""
    mask = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))


def shard_of(keys: list[Column], shards: int) -> Column:
    text = F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    h = fnv1a_column(text)
    # the remainder of the unsigned value
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(shards)) * 2 + h.bitwiseAND(F.lit(1)), F.lit(shards)).cast("int")


def with_shards(reads: DataFrame, shards: int, keys: tuple[str, ...] = ("qname",)) -> DataFrame:
    if "qname" not in keys:
        warnings.warn("records of one fragment may come to different shards", stacklevel=2)
    return reads.withColumn("shard", shard_of([F.col(k) for k in keys], shards))
