"""Removal of repeated word sequences, found by difference-cover anchors.

A set of residues is a difference cover of a period when each difference between two
positions is a difference of two residues.  Anchors are short word sequences that
start at positions whose residue is in the cover.  Two equal windows, wherever they
start, then share an anchor at the same distance from their starts.  So only windows
with an anchor that occurs again can be repeated; those are extended to whole windows
and compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.llm import _vector as V
from baseloom.llm._scratch import Scratch
from baseloom.llm._windows import FLUSH, Answers, Entries, answered, covered, exchange, groups, keyed, later_windows, partitions

WINDOW = 20
#: Perfect difference covers, as fixed values: period and residues.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, residues, words in an anchor): the sparsest cover that leaves anchors of a third of the window at least, else every position."""
    for period, residues in sorted(COVERS.items(), reverse=True):
        if window - period + 1 >= max(1, window // 3):
            return period, residues, window - period + 1
    return 1, (0,), window


def _words(block: V.Block, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = V.split_words(block)
    return V.spans(block.data, starts, ends, seed), first


def _places(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, index among the block's words) of all spans of width words inside texts."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pos = np.arange(first[-1]) - first[doc] if len(doc) else np.zeros(0, np.int64)
    ok = np.flatnonzero(pos + width <= np.diff(first)[doc]) if len(doc) else np.zeros(0, np.int64)
    return doc[ok], pos[ok], ok


def repeated_anchors(docs: DataFrame, window: int, tasks: int) -> DataFrame:
    """Answers ``at``: positions of a document's anchors that occur elsewhere too."""
    period, residues, width = cover_for(window)
    at_cover = np.isin(np.arange(period), residues)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held = Entries(("h", "id", "rk", "pos"))
        for batch in batches:
            ids, rks = V.idents(batch)
            for block in V.blocks(batch):
                words, first = _words(block)
                doc, pos, k = _places(first, width)
                use = at_cover[pos % period]
                doc, pos, k = doc[use], pos[use], k[use]
                held.add(h=V.windows(words, width)[k], id=ids[block.rows][doc], rk=rks[block.rows][doc], pos=pos.astype(np.int32))
                if held.size >= FLUSH:
                    yield held.take()
        if held.size:
            yield held.take()

    def send(batches):
        for at in anchors(batches):
            order, starts = groups([at["h"]])
            sizes = np.diff(np.append(starts, len(order)))
            twice = np.empty(len(order), bool)
            twice[order] = np.repeat(sizes > 1, sizes)
            one = {k: v[order[starts]] for k, v in at.items()}
            one["pos"] = np.where(sizes > 1, np.int32(-1), one["pos"])  # known to occur again: wants no answer
            yield one, {"id": at["id"][twice], "rk": at["rk"][twice], "at": at["pos"][twice]}

    def receive(at):
        order, starts = groups([at["h"]])
        sizes = np.diff(np.append(starts, len(order)))
        again = np.empty(len(order), bool)
        again[order] = np.repeat(sizes > 1, sizes)
        again &= at["pos"] >= 0
        return {"id": at["id"][again], "rk": at["rk"][again], "at": at["pos"][again]}

    return exchange(docs, send, receive, {"h": np.uint64, "pos": np.int32}, ("at",), tasks)


def substring_dedup(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text.

    A word is removed when a window of that many consecutive words covers it which also
    starts earlier: in a document of smaller id, or in the same one before.  Windows
    are judged on the input.  Null and empty texts have no words; texts shorter than a
    window lose none.  Null ids count as smaller than all others; rows that share an id
    but not the text come in the order of a hash of the text; rows that share both are
    one document, so neither removes the other's words.  Other columns are ignored.
    Windows compare by 128 bits of hash.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    scratch, rows = Scratch(docs.sparkSession), keyed(docs, text_col, id_col)
    period, _, width = cover_for(window)
    texts = rows.select("id", "rk", "text")
    tasks = partitions(texts)
    anchored = scratch.write(repeated_anchors(texts, window, tasks))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held = Entries(("h1", "h2", "id", "rk", "pos"))
        for batch in batches:
            ids, rks = V.idents(batch)
            found = Answers(batch, "at")
            for block in V.blocks(batch):
                words, first = _words(block)
                doc, pos, k = _places(first, window)
                if not len(doc):
                    continue
                edge = np.zeros(first[-1] + 1, np.int64)
                for i in range(len(block)):
                    at = found[block.rows.start + i] + first[i]
                    np.add.at(edge, np.maximum(at - (period - 1), first[i]), 1)
                    np.add.at(edge, at + 1, -1)
                use = np.cumsum(edge)[k] > 0
                doc, pos, k = doc[use], pos[use], k[use]
                other, _ = _words(block, V.BASE_2)
                held.add(h1=V.windows(words, window)[k], h2=V.windows(other, window, V.BASE_3)[k], id=ids[block.rows][doc], rk=rks[block.rows][doc], pos=pos.astype(np.int32))
                if held.size >= FLUSH:
                    yield held.take()
        if held.size:
            yield held.take()

    later = scratch.write(later_windows(answered(texts, anchored, "inner"), windows, tasks))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Answers(batch, "later")
            offs, data = V.buffers(batch.column(batch.schema.get_field_index("text")))
            total, gone, kept = [], [], []
            for i in range(batch.num_rows):
                words = data[offs[i] : offs[i + 1]].tobytes().split()
                starts = found[i]
                total.append(len(words))
                if len(starts):
                    off = covered(len(words), starts, window).tolist()
                    words = [w for w, out in zip(words, off, strict=True) if not out]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return answered(rows, later, "left").select("doc_id", "text", "later").mapInArrow(finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
f AS (SELECT k, min((doc_id, s)) AS first, count(*) AS n FROM win GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, s FROM win JOIN f USING (k) WHERE (doc_id, s) > first),
gone AS (SELECT DISTINCT doc_id, s + d AS i FROM later CROSS JOIN range(20) AS t(d)),
kept AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w) ANTI JOIN gone USING (doc_id, i)),
per AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""
