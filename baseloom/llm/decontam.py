"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ from a passage by ``budget(n)`` word insertions,
deletions and substitutions.  Cut into one piece more than that, some piece of it must
stand unchanged in the passage.  So documents are searched for exact pieces, and the
words around a hit are verified with Myers' bit-parallel edit distance.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case, so
case, punctuation and spacing don't count as edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.llm import _vector as V
from baseloom.llm._rowwise import beside

RATE = 0.15
#: Items with fewer words may turn up by chance: they are searched as they stand, without edits.
MIN_WORDS = 6
#: Items are broadcast in parts of about so many bytes of text; each part is a pass over the documents.
PART_BYTES = 8 << 20

_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def budget(n: int, rate: float = RATE) -> int:
    return int(n * rate)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the words' hashes, and of each text the index of its first word, and the number of words."""
    plain = V.LOWER[data]
    plain = np.where(_OTHER[data], np.uint8(32), plain)
    block = V.Block(slice(0, len(offs) - 1), plain, offs)
    starts, ends, first = V.split_words(block)
    return V.spans(plain, starts, ends), first


def distance(item: np.ndarray, words: np.ndarray) -> int:
    """The least number of word edits between item and any run of words, by Myers' bit vectors (1999)."""
    m, at = len(item), {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pos, neg, score = full, 0, m
    least = m
    for w in words.tolist():
        eq = at.get(w, 0)
        diag = (((eq & pos) + pos) ^ pos) | eq | neg
        up = neg | (full & ~(diag | pos))
        down = pos & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up <<= 1  # a match may start anywhere, so the first row is all zeros
        down <<= 1
        pos = full & (down | ~(diag | up))
        neg = up & diag & full
        least = min(least, score)
    return least


@dataclass
class Pieces:
    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    #: Hashes of the pieces' first words, sorted, with the piece of each.
    grams: np.ndarray
    item: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    width: int
    rate: float

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], rate: float, least: int, most: int | None = None) -> Pieces | None:
        """Pieces of the items with that many words; None without any."""
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offs = np.cumsum([0, *(len(t) for _, t in items)])
        words, first = words_of(data, offs)
        item, start, stop = [], [], []
        for i, n in enumerate(np.diff(first).tolist()):
            if n < max(1, least) or (most is not None and n > most):
                continue
            parts = budget(n, rate) + 1
            cuts = [j * n // parts for j in range(parts + 1)]
            item += [i] * parts
            start += cuts[:-1]
            stop += cuts[1:]
        if not item:
            return None
        item, start, stop = map(np.array, (item, start, stop))
        width = int((stop - start).min())
        grams = V.windows(words, width)[first[item] + start]
        order = np.argsort(grams)
        return cls(np.array([i for i, _ in items]), words, first, grams[order], item[order], start[order], stop[order], width, rate)

    def find(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item's place, least edits, word where the first passage with so few starts) of each item found in a text."""
        here = V.windows(words, self.width)
        if not len(here):
            return
        small = np.zeros(1 << 16, bool)
        small[self.grams & np.uint64(0xFFFF)] = True
        maybe = np.flatnonzero(small[here & np.uint64(0xFFFF)])
        at = np.searchsorted(self.grams, here[maybe])
        maybe = maybe[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == here[maybe])]
        texts = np.searchsorted(first, maybe, "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for q, d in zip(maybe.tolist(), texts.tolist(), strict=True):
            lo, hi = int(first[d]), int(first[d + 1])
            for p in range(int(np.searchsorted(self.grams, here[q])), int(np.searchsorted(self.grams, here[q], "right"))):
                i, s, e = int(self.item[p]), int(self.start[p]), int(self.stop[p])
                base = int(self.first[i])
                known = best.get((d, i))
                if known and known[0] == 0 or (d, i, q - s) in tried:
                    continue
                if q + e - s > hi or not np.array_equal(words[q : q + e - s], self.words[base + s : base + e]):
                    continue
                tried.add((d, i, q - s))
                whole = self.words[base : int(self.first[i + 1])]
                k = budget(len(whole), self.rate)
                edits = distance(whole, words[max(lo, q - s - k) : min(hi, q - s + len(whole) + k)])
                if edits <= k and (not known or edits < known[0]):
                    best[d, i] = edits, max(lo, q - s) - lo
        for (d, i), (edits, word) in best.items():
            yield d, i, edits, word


def _parts(benchmark: DataFrame, text_col: str, id_col: str, part_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("bigint"), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator():
        text = row[1].encode()
        held.append((row[0] if row[0] is not None else V.NULL_ID, text))
        size += len(text)
        if size >= part_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


HIT = "array<struct<item_id:bigint,edits:int,word:int>>"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS,
    text_col: str = "text", bench_text: str = "text", bench_id: str = "item_id", part_bytes: int = PART_BYTES, hits_col: str = "hits",
) -> DataFrame:
    """All rows and columns, with ``hits``: item_id, edits and the passage's first word of each item found, by item_id.

    edits is the least of all passages of a text; word is where the first passage with
    so few starts.  Null and empty texts have no hits; null items and items without
    words have no matches, and items under min_words words only exact ones; items of
    null id show as the least bigint.  Whole texts are searched.  Without items all
    hits are empty.  Equal items each hit; repeated rows have the same hits.  A column
    named as hits_col is replaced; all others stay, whatever their names.  The benchmark
    is broadcast in parts of a bounded size, one pass each; a pass shuffles nothing.
    """
    spark, more = docs.sparkSession, f"more_{uuid4().hex}"
    out = docs.withColumn(hits_col, F.array().cast(HIT))
    for items in _parts(benchmark, bench_text, bench_id, part_bytes):
        # short items apart: one piece's width is that of all
        pieces = [p for p in (Pieces.of(items, rate, min_words), Pieces.of(items, 0.0, 1, min_words - 1)) if p]
        if not pieces:
            continue
        shared = spark.sparkContext.broadcast(pieces)

        def compute(batch: pa.RecordBatch, shared=shared) -> dict[str, pa.Array]:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for block in V.blocks(batch):
                words, first = words_of(block.data, block.offs)
                for p in shared.value:
                    for d, i, edits, at in p.find(words, first):
                        found[block.rows.start + d].append({"item_id": int(p.ids[i]), "edits": edits, "word": at})
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("word", pa.int32())]))
            return {more: pa.array(found, kind)}

        out = beside(out, text_col, compute, f"`{more}` {HIT}")
        out = out.withColumn(hits_col, F.array_sort(F.concat(F.col(f"`{hits_col}`"), F.col(more)))).drop(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without hits, with the columns of the input."""
    name = f"hits_{uuid4().hex}"
    found = decontaminate(docs, benchmark, hits_col=name, **options)
    return found.filter(F.size(name) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs.select("doc_id", "text"), bench)
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"), F.array_min("hits.edits").alias("least_edits"))
