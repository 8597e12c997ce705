"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``depth`` bytes, by passes from the most significant
digit on; what ends in equal groups are exactly the repeated windows, and groups of
one drop out after the first pass that shows them.

The first digit of a suffix isn't its first bytes but the gram of ``GRAM`` bytes in its
window that has the smallest hash (the leftmost of equals), and where in the window it
is.  Equal windows have equal first digits, and neighbouring suffixes mostly share
their gram, so one entry stands for a *block*: the run of suffixes whose first digit is one occurrence of a
gram.

* The first pass deals blocks by gram.  Blocks alone in their group hold no repeats.
  Blocks of equal bytes around a gram are equal suffix by suffix, and all but the first
  are repeats.
* Blocks of unequal bytes around an equal gram go on with their bytes.  A task sorts the
  suffixes of a gram by the digits that remain, eight bytes from the front in each pass.
* Grams with more than ``MOST_KINDS`` kinds of blocks would make a task's group unbounded: their
  suffixes are dealt one by one instead, by a hash of all ``depth`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.llm import _vector as V
from baseloom.llm._scratch import Scratch
from baseloom.llm._windows import FLUSH, Answers, Entries, answered, exchange, first_of, groups, keyed, later_windows, partitions

DEPTH = 100
GRAM = 32
#: A block's start and its number of suffixes share an answer.
SPAN_BITS = 12
#: Unequal blocks of a gram that are sorted in one task.
MOST_KINDS = 4096
#: Bytes of a digit.
DIGIT = 8


def _leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each width neighbouring values is, the leftmost of equals."""
    n, have, at = len(x) - width + 1, 1, np.arange(len(x))
    while have * 2 <= width:
        a, b = at[:-have], at[have:]
        at = np.where(x[b] < x[a], b, a)
        have *= 2
    a, b = at[:n], at[width - have : width - have + n]
    return np.where((x[b] < x[a]) | (x[b] == x[a]) & (b < a), b, a)


def find_blocks(block: V.Block, depth: int, gram: int) -> dict[str, np.ndarray]:
    """doc, pos (of the first suffix), n (suffixes), at (the gram in the first suffix), h (hash of the gram), key (hash of all bytes that the suffixes reach, and of where the gram is in them)."""
    none = dict.fromkeys(("doc", "pos", "n", "at"), np.zeros(0, np.int64)) | dict.fromkeys(("h", "key"), np.zeros(0, np.uint64))
    size = len(block.data)
    if size < depth:
        return none
    grams = V.windows(V.of_bytes(block.data), gram)
    at = _leftmost_least(grams, depth - gram + 1)
    doc = np.repeat(np.arange(len(block)), np.diff(block.offs))[: len(at)]
    inside = np.arange(len(at)) + depth <= block.offs[doc + 1]
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    if not len(starts):
        return none
    stop = inside.copy()
    stop[:-1] &= (at[1:] != at[:-1]) | ~inside[1:] | (doc[1:] != doc[:-1])
    n = np.flatnonzero(stop) + 1 - starts
    g = at[starts]
    around = V.covering(grams, gram, starts, starts + n - 1 + depth)
    shape = ((g - starts).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
    return {"doc": doc[starts], "pos": starts - block.offs[doc[starts]], "n": n, "at": g - starts, "h": grams[g], "key": V.join(around, V.mix(shape))}


def first_pass(texts: DataFrame, depth: int, gram: int, most_kinds: int, tasks: int) -> DataFrame:
    """Answers ``later``: blocks that repeat an earlier one as a whole; ``mixed`` and ``many``: blocks to sort, of grams with few and with many kinds."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held = Entries(("h", "id", "rk", "key", "pos", "n"))
        for batch in batches:
            ids, rks = V.idents(batch)
            for block in V.blocks(batch):
                b = find_blocks(block, depth, gram)
                held.add(h=b["h"], id=ids[block.rows][b["doc"]], rk=rks[block.rows][b["doc"]], key=b["key"], pos=b["pos"].astype(np.int32), n=b["n"].astype(np.int16))
                if held.size >= FLUSH:
                    yield held.take()
        if held.size:
            yield held.take()

    def answer(at, **which):
        span = (at["pos"].astype(np.int64) << SPAN_BITS) | at["n"]
        use = np.logical_or.reduce(list(which.values()))
        none = np.zeros(len(span), bool)
        return {"id": at["id"][use], "rk": at["rk"][use]} | {k: np.where(which.get(k, none), span, -1)[use] for k in ("later", "mixed", "many")}

    def send(batches):
        for at in found(batches):
            first = first_of([at["h"], at["key"]], at)
            yield {k: v[first] for k, v in at.items()}, answer(at, later=~first)

    def receive(at):
        first = first_of([at["h"], at["key"]], at)
        order, starts = groups([at["h"]])
        kinds = np.empty(len(order), np.int64)
        kinds[order] = np.repeat(np.add.reduceat(first[order].astype(np.int64), starts), np.diff(np.append(starts, len(order))))
        return answer(at, later=~first, mixed=first & (kinds > 1) & (kinds <= most_kinds), many=first & (kinds > most_kinds))

    return exchange(texts, send, receive, {"h": np.uint64, "key": np.uint64, "pos": np.int32, "n": np.int16}, ("later", "mixed", "many"), tasks)


def sorted_groups(first: list[np.ndarray], bytes_of: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, group of each) of the suffixes that aren't alone, in their order through depth bytes after the first digit.

    Suffix i has its bytes from at[i] on in bytes_of.  Each pass sorts what is left
    inside its groups by the next digit.
    """
    digits = np.ndarray((max(0, len(bytes_of) - DIGIT + 1),), ">u8", bytes_of, strides=(1,))
    left = np.arange(len(at))
    group, step = np.zeros(len(at), np.int64), min(DIGIT, depth)
    for place in range(-step, depth, step):
        if place < 0:
            keys = [k[left] for k in first]
        elif step == DIGIT:
            keys = [group, digits[at[left] + min(place, depth - DIGIT)].astype(np.uint64)]
        else:
            keys = [group, *(bytes_of[at[left] + k] for k in range(depth))]
        order, starts = groups(keys)
        sizes = np.diff(np.append(starts, len(order)))
        use = np.repeat(sizes > 1, sizes)
        left, group = left[order[use]], np.repeat(np.arange(len(sizes)), sizes)[use]
    return left, group


def radix_passes(texts: DataFrame, depth: int, gram: int, tasks: int) -> DataFrame:
    """texts with ``mixed``.  Answers ``later``: starts of windows that also start earlier in a block of the same gram."""
    reach = 2 * depth - gram
    body = np.dtype((np.void, reach))

    def entries(batches):
        held = Entries(("h", "at", "n", "body", "id", "rk", "pos"))
        for batch in batches:
            ids, rks = V.idents(batch)
            wanted = Answers(batch, "mixed")
            for block in V.blocks(batch):
                b = find_blocks(block, depth, gram)
                starts = b["pos"] + block.offs[b["doc"]]
                marks = np.concatenate([(wanted[block.rows.start + i] >> SPAN_BITS) + block.offs[i] for i in range(len(block))])
                use = np.flatnonzero(np.isin(starts, marks))
                if not len(use):
                    continue
                data = np.concatenate([block.data, np.zeros(reach, np.uint8)])
                whole = np.lib.stride_tricks.sliding_window_view(data, reach)[starts[use]]
                doc = b["doc"][use]
                held.add(
                    h=b["h"][use], at=b["at"][use].astype(np.int16), n=b["n"][use].astype(np.int16), body=np.ascontiguousarray(whole).view(body).reshape(-1),
                    id=ids[block.rows][doc], rk=rks[block.rows][doc], pos=b["pos"][use].astype(np.int32),
                )
                if held.size * reach >= 16 << 20:
                    yield held.take()
        if held.size:
            yield held.take()

    def send(batches):
        none = np.zeros(0, np.int64)
        for at in entries(batches):
            yield at, {"id": none, "rk": none, "later": none}

    def receive(at):
        n = at["n"].astype(np.int64)
        block = np.repeat(np.arange(len(n)), n)
        o = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
        flat = np.ascontiguousarray(at["body"]).view(np.uint8)
        left, group = sorted_groups([at["h"][block], (at["at"].astype(np.int64)[block] - o).astype(np.int16)], flat, block * reach + o, depth)
        block, o = block[left], o[left]
        where = {"id": at["id"][block], "rk": at["rk"][block], "pos": at["pos"][block] + o}
        again = ~first_of([group], where) if len(group) else np.zeros(0, bool)
        return {"id": where["id"][again], "rk": where["rk"][again], "later": where["pos"][again].astype(np.int64)}

    return exchange(texts, send, receive, {"h": np.uint64, "at": np.int16, "n": np.int16, "body": body, "pos": np.int32}, ("later",), tasks)


def _spans(got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = got >> SPAN_BITS
    return lo, lo + (got & ((1 << SPAN_BITS) - 1))


def _marked(size: int, got: np.ndarray) -> np.ndarray:
    """Which of size suffixes lie in one of the blocks."""
    lo, hi = _spans(got)
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_dedup(docs: DataFrame, depth: int = DEPTH, text_col: str = "text", id_col: str = "doc_id", gram: int | None = None, most_kinds: int = MOST_KINDS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    A byte is removed when a string of ``depth`` bytes covers it that also starts earlier:
    in a document of smaller id, or in the same one before.  Strings are judged on the
    input and stay inside a document; kept bytes need not be UTF-8.  Null texts count as
    empty; texts shorter than ``depth`` lose nothing.  Null ids count as smaller than all
    others; rows that share an id but not the text come in the order of a hash of the
    text; rows that share both are one document.  Other columns are ignored.  Strings
    compare by their bytes; whole blocks of them by 64 bits of hash for each gram, and
    those of grams with over most_kinds kinds of blocks by 128 bits of hash.
    """
    gram = gram or min(GRAM, max(1, depth // 3))
    if not 1 <= gram <= depth < 1 << SPAN_BITS:
        raise ValueError(f"depth must be from 1 to {(1 << SPAN_BITS) - 1}, and the gram no longer")
    scratch, rows = Scratch(docs.sparkSession), keyed(docs, text_col, id_col)
    texts = rows.select("id", "rk", "text")
    tasks = partitions(texts)
    passed = scratch.write(first_pass(texts, depth, gram, most_kinds, tasks))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held = Entries(("h1", "h2", "id", "rk", "pos"))
        for batch in batches:
            ids, rks = V.idents(batch)
            mixed = Answers(batch, "many")
            for block in V.blocks(batch):
                for i in range(len(block)):
                    j = block.rows.start + i
                    got = mixed[j]
                    if not len(got):
                        continue
                    data = block.data[block.offs[i] : block.offs[i + 1]]
                    pos = at = np.flatnonzero(_marked(len(data), got))
                    one, two = V.windows(V.of_bytes(data), depth), V.windows(V.of_bytes(data, V.BASE_2), depth)
                    held.add(h1=one[at], h2=two[at], id=np.full(len(at), ids[j]), rk=np.full(len(at), rks[j]), pos=pos.astype(np.int32))
                    if held.size >= FLUSH:
                        yield held.take()
        if held.size:
            yield held.take()

    marked = lambda name: answered(texts, passed.filter(F.octet_length(name) > 0).select("id", "rk", name), "inner")
    few = scratch.write(radix_passes(marked("mixed"), depth, gram, tasks))
    many = scratch.write(later_windows(marked("many"), suffixes, tasks))
    both = passed.select("id", "rk", F.col("later").alias("blocks")).join(few, ["id", "rk"], "full").join(many.withColumnRenamed("later", "others"), ["id", "rk"], "full")
    both = both.select("id", "rk", "blocks", F.concat(F.coalesce("later", F.lit(b"")), F.coalesce("others", F.lit(b""))).alias("later"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, spans = Answers(batch, "later"), Answers(batch, "blocks")
            offs, data = V.buffers(batch.column(batch.schema.get_field_index("text")))
            total, gone, runs, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = data[offs[i] : offs[i + 1]]
                starts, got = found[i], spans[i]
                total.append(len(text))
                if not len(starts) and not len(got):
                    gone.append(0)
                    runs.append(0)
                    kept.append(text.tobytes())
                    continue
                lo, hi = _spans(got)
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, np.concatenate([starts, lo]), 1)
                np.add.at(edge, np.concatenate([starts + depth, hi - 1 + depth]), -1)
                off = np.cumsum(edge[:-1]) > 0
                gone.append(int(off.sum()))
                runs.append(int(off[0]) + int((off[1:] & ~off[:-1]).sum()))
                kept.append(text[~off].tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return answered(rows, both, "left").select("doc_id", "text", "later", "blocks").mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
