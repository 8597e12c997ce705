"""NumPy over the bytes of Arrow batches: words, window hashes and packed exchanges.

A *block* is some consecutive texts of a batch, about ``BLOCK`` bytes or one longer
text, so that the working arrays stay near the caches.  Words are hashed eight bytes at
a time, windows by joining halves; every step is mixed, so no sum of powers can cancel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 20
#: Null identifiers come before all others.
NULL_ID = -(2**63)
BASE_1, BASE_2, BASE_3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    rows: slice
    data: np.ndarray
    #: Where each text starts in data, and the end.
    offs: np.ndarray

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def __len__(self) -> int:
        return len(self.offs) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def idents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("id", "rk"))


def blocks(batch: pa.RecordBatch, name: str = "text") -> Iterator[Block]:
    offs, data = buffers(batch.column(batch.schema.get_field_index(name)))
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK, "right")) - 1)
        yield Block(slice(lo, hi), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def split_words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): bytes where words start and end; of each text the index of its first word, and the number of words."""
    blank = IS_BLANK[block.data]
    start, end = ~blank, ~blank
    start[1:] &= blank[:-1]
    end[:-1] &= blank[1:]
    inner = block.offs[(block.offs > 0) & (block.offs < len(blank))]
    start[inner] = ~blank[inner]
    end[inner - 1] = ~blank[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, block.offs)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, in which the order counts."""
    h = a * np.uint64(BASE_1)
    h ^= h >> np.uint64(32)
    h += b
    h *= np.uint64(BASE_2)
    h ^= h >> np.uint64(29)
    return h


#: Spans of more bytes are hashed one by one.
LONG = 512
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each span, which take turns to be mixed in, eight at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(BASE_3) + np.uint64(seed))
    long = np.flatnonzero(size > LONG)
    for i in long.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    left, some = size.copy(), slice(None)
    left[long] = 0
    at = starts
    while True:
        value = eight[at] & _HEAD[np.minimum(left, 8)]
        h[some] = np.where(left > 0, join(h[some], value), h[some])
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        some, at, left = (more if isinstance(some, slice) else some[more]), at[more] + 8, left[more] - 8


_BYTES = {}


def of_bytes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each byte."""
    if seed not in _BYTES:
        _BYTES[seed] = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE_3) + np.uint64(seed))
    return _BYTES[seed][data]


def windows(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each width neighbouring values: two halves are joined, and so on, the last ones overlapping."""
    n, have, out = len(values) - width + 1, 1, values ^ np.uint64(seed)
    if n <= 0:
        return np.zeros(0, np.uint64)
    while have * 2 <= width:
        out = join(out[:-have], out[have:])
        have *= 2
    return mix(join(out[:n], out[width - have : width - have + n]))


def covering(hashes: np.ndarray, width: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, from the hashes of windows of that width that cover them one after another; no span is shorter."""
    h = (ends - starts).astype(np.uint64)
    for at in range(0, int((ends - starts).max(initial=0)), width):
        h = join(h, hashes[np.minimum(starts + at, ends - width)])
    return mix(h)


def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of values between neighbouring cuts."""
    values = np.ascontiguousarray(values)
    if len(values) * values.itemsize >= 1 << 31:
        raise OverflowError("packed values of a batch must stay under 2 GB")
    offs = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offs), pa.py_buffer(values)])


def packed(bucket: np.ndarray, count: int, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """For each bucket the values of each column, as binaries."""
    order = np.argsort(bucket.astype(np.uint16) if count <= 1 << 16 else bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(count + 1))
    return {k: binary(v[order], cuts) for k, v in columns.items()}


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    offs, data = buffers(column)
    return data[offs[0] : offs[-1]].view(kind) if offs[-1] > offs[0] else np.zeros(0, kind)


def by_doc(ids: np.ndarray, rks: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each (id, rk), with its values that aren't negative packed."""
    order = np.lexsort((rks, ids))
    i, r = ids[order], rks[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1])
    at, doc = np.flatnonzero(new), np.cumsum(new) - 1
    arrays = {"id": pa.array(i[at]), "rk": pa.array(r[at])}
    for k, v in values.items():
        v = v[order]
        use = v >= 0
        arrays[k] = binary(v[use], np.concatenate([[0], np.cumsum(np.bincount(doc[use], minlength=len(at)))]))
    return pa.RecordBatch.from_pydict(arrays)


def rank(ids: np.ndarray, rks: np.ndarray) -> np.ndarray:
    """For each entry the place of its document in the order of (id, rk), from 0; equal ones share it."""
    order = np.lexsort((rks, ids))
    i, r = ids[order], rks[order]
    new = np.zeros(len(i), np.uint64)
    new[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1])
    out = np.empty(len(i), np.uint64)
    out[order] = np.cumsum(new, dtype=np.uint64)
    return out


def groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order that brings equal entries together, and where groups start in it."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)
