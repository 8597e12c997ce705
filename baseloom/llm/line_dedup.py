"""Line deduplication with two Bloom filters.

The first filter takes every line hash that is seen, the second those that the first
already had.  Both are cut in slices by hash; a task owns whole slices and reads their
hashes as a stream, so it holds two slices and no table of lines.  For that each task
sends eight bytes for a line, however often it has it.  The second filter is sized by
the input up to a bound and broadcast: only lines that it has, suspected repeats, are
shuffled with their documents, for exact confirmation and for the choice of the
document that keeps the line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.llm import _vector as V
from baseloom.llm._hot import join_hot
from baseloom.llm._scratch import Scratch
from baseloom.llm._windows import answered, keyed, partitions

MIN_CHARS = 40
MIN_DOCS = 5
#: Bits of a filter for each line that the input may have, and the bound of a filter: 64 MB.  More lines make more suspects, never another result.
BITS_A_LINE, MAX_FILTER_BITS = 8, 1 << 29
SLICES = 256
PROBES = 4
FLUSH = 400_000
EDGES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key; None where the key is too short."""
    key = line.strip(EDGES).lower()  # bytes.lower() changes A-Z alone
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode(errors="surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _bits(h: np.ndarray, per_slice: int) -> list[np.ndarray]:
    step = V.mix(h) | np.uint64(1)
    return [(((h + np.uint64(i) * step) >> np.uint64(8)) % np.uint64(per_slice)).astype(np.int64) for i in range(PROBES)]


def filter_bits(texts: DataFrame, min_chars: int) -> int:
    """A power of two for the lines of min_chars that fit into all texts."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    return min(MAX_FILTER_BITS, 1 << max(20, (BITS_A_LINE * size // (min_chars + 1)).bit_length()))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    offs, data = V.buffers(batch.column(batch.schema.get_field_index("text")))
    for i in range(batch.num_rows):
        yield data[offs[i] : offs[i + 1]].tobytes()


def _digests(text: bytes, min_chars: int) -> list[bytes]:
    return list({k for k in (line_key(line, min_chars) for line in text.split(b"\n")) if k})


def repeated_filter(texts: DataFrame, min_chars: int, bits: int) -> bytes:
    """The filter of hashes seen in a second document, by slice; its size is fixed by bits."""
    per_slice, tasks = max(64, bits // SLICES), partitions(texts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            h, count = np.unique(np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)[:, 0], return_counts=True)
            held.clear()
            parts = {}
            for name, some in (("one", h[count == 1]), ("more", h[count > 1])):
                parts |= V.packed((some % np.uint64(SLICES)).astype(np.int64), SLICES, {name: some})
            return pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(SLICES, dtype=np.int32))} | parts)

        for batch in batches:
            for text in _texts(batch):
                held += _digests(text, min_chars)
                if len(held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                if k not in once:
                    once[k], twice[k] = np.zeros(per_slice, bool), np.zeros(per_slice, bool)
                for j, several in ((1, False), (2, True)):
                    at = _bits(V.unpacked(batch.column(j).slice(i, 1), np.uint64), per_slice)
                    again = np.logical_or(several, np.logical_and.reduce([once[k][x] for x in at]))
                    for x in at:
                        once[k][x] = True
                        twice[k][x[again]] = True
        for k, found in twice.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(found).tobytes()], pa.binary())})

    sent = texts.mapInArrow(send, "slice int, one binary, more binary").repartition(tasks, "slice")
    out = np.zeros((SLICES, per_slice // 8), np.uint8)
    for row in sent.mapInArrow(build, "slice int, bits binary").toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text_col: str = "text", id_col: str = "doc_id", bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    Lines are what newlines separate; null and empty texts have one empty line.  A
    line's key is the line without blanks at its ends, A-Z in lower case.  A key of
    min_chars code points found in min_docs rows loses all its lines except in the row of largest id that
    holds it; there all stay.  Rows that share the largest id all keep
    theirs.  Null ids count as smaller than all others.  Other columns are ignored.
    Keys compare by 128 bits of hash.  bits: the size of a filter, if not by the input.
    """
    spark = docs.sparkSession
    scratch, rows = Scratch(spark), keyed(docs, text_col, id_col)
    bits = bits or filter_bits(rows, min_chars)
    per_slice = max(64, bits // SLICES)
    again = spark.sparkContext.broadcast(repeated_filter(rows.select("text"), min_chars, bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(again.value, np.uint8).reshape(SLICES, -1)
        for batch in batches:
            ids, rks = V.idents(batch)
            keys, count = [], []
            for text in _texts(batch):
                got = _digests(text, min_chars)
                keys += got
                count.append(len(got))
            if not keys:
                continue
            h = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
            part = (h[:, 0] % np.uint64(SLICES)).astype(np.int64)
            use = np.ones(len(h), bool)
            for x in _bits(h[:, 0], per_slice):
                use &= (bits[part, x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 > 0
            doc = np.repeat(np.arange(len(count)), count)[use]
            yield pa.RecordBatch.from_pydict({"key": V.binary(h[use], np.arange(len(doc) + 1) * 2), "id": pa.array(ids[doc]), "rk": pa.array(rks[doc])})

    suspects = scratch.write(rows.select("id", "rk", "text").mapInArrow(suspected, "key binary, id bigint, rk bigint"))
    confirmed = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs)
    again.destroy()
    confirmed = scratch.write(confirmed)
    lost = join_hot(suspects, confirmed, ["key"], "n", suspects.count()).filter("id < keeper").groupBy("id", "rk").agg(F.collect_list("key").alias("keys"))
    lost = scratch.write(lost)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, keys in zip(_texts(batch), batch.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                total.append(len(lines))
                if keys:
                    out = set(keys)
                    lines = [x for x in lines if line_key(x, min_chars) not in out]
                gone.append(total[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return answered(rows, lost, "left").select("doc_id", "text", "keys").mapInArrow(finish, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, k.keeper IS NOT NULL AND l.doc_id < k.keeper AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
