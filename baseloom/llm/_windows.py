"""Which windows of a corpus also start earlier: exchanges shared by the two substring operators.

Tasks combine what they hold before anything is shuffled: of equal keys a task sends
one entry, and it settles the others itself, because an earlier start in the same task
is an earlier start.  So no key, however frequent, brings more than an entry for each
flush of a task.  What a receiving task decides goes back to the documents as packed
positions; no list of partners is ever built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baseloom.llm._vector import NULL_ID, buffers, by_doc, groups, packed, rank, unpacked

FLUSH = 400_000
DOCS = "id bigint, rk bigint"


def keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, id, rk, text): id without nulls, rk a hash that tells rows of one id apart.

    Ids are whole numbers, or texts of such; others are an error in ANSI mode.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident = F.col(f"`{id_col}`").cast("bigint")
    return docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit(NULL_ID)).alias("id"), F.xxhash64(ident, text).alias("rk"), text.alias("text"))


#: Text that the entries of one task come from, on average.
TASK_BYTES = 64 << 20


def partitions(texts: DataFrame) -> int:
    """Tasks of an exchange: as many as are configured, or more, so that what a task holds doesn't grow with the input."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def empty(schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([], t) for k, t in schema.items()})


class Entries:
    """Columns of entries that grow until they are flushed."""

    def __init__(self, names: tuple[str, ...]):
        self.parts: dict[str, list[np.ndarray]] = {n: [] for n in names}
        self.size = 0

    def add(self, **columns: np.ndarray) -> None:
        for k, v in columns.items():
            self.parts[k].append(v)
        self.size += len(v)

    def take(self) -> dict[str, np.ndarray]:
        out = {k: np.concatenate(v) for k, v in self.parts.items()}
        self.parts, self.size = {k: [] for k in self.parts}, 0
        return out


def exchange(df: DataFrame, send: Callable, receive: Callable, sent: dict[str, type], answer: tuple[str, ...], tasks: int) -> DataFrame:
    """(id, rk, answers): a row for each document with answers, each kind of them packed.

    send: from batches to (entries, own answers).  receive: from all entries of some keys
    to answers.  sent: the types of an entry's columns beside id and rk, the key first.
    Answers are columns of positions beside id and rk; -1 stands for none.  Both trips
    go packed: a row holds what a task has for a bucket of keys, or of documents.
    """
    count = 2 * tasks
    names = {"id": np.int64, "rk": np.int64} | sent
    answers = {"id": np.int64, "rk": np.int64} | dict.fromkeys(answer, np.int64)
    own = {f"own_{k}": t for k, t in answers.items()}
    key = next(iter(sent))
    numbers = pa.array(np.arange(count, dtype=np.int32))

    def at_home(got: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        home = (got["rk"].view(np.uint64) % np.uint64(count)).astype(np.int64)
        return packed(home, count, {k: got[k].astype(t, copy=False) for k, t in answers.items()})

    def sending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries, settled in send(batches):
            bucket = ((entries[key] >> np.uint64(20)) % np.uint64(count)).astype(np.int64)
            columns = packed(bucket, count, {k: entries[k].astype(t, copy=False) for k, t in names.items()})
            columns |= {f"own_{k}": v for k, v in at_home(settled).items()}
            yield pa.RecordBatch.from_pydict({"bucket": numbers} | columns)

    def receiving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for at in _by_bucket(batches, names | own):
            parts.append({k: at[f"own_{k}"] for k in answers})
            if len(at[key]):
                got = receive({k: at[k] for k in names})
                parts.append({k: got[k].astype(np.int64, copy=False) for k in answers})
            size += sum(len(p["id"]) for p in parts[-2:])
            if size >= 4 * FLUSH:
                yield pa.RecordBatch.from_pydict({"bucket": numbers} | at_home({k: np.concatenate([p[k] for p in parts]) for k in answers}))
                parts, size = [], 0
        if size:
            yield pa.RecordBatch.from_pydict({"bucket": numbers} | at_home({k: np.concatenate([p[k] for p in parts]) for k in answers}))

    def gathering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in _by_bucket(batches, answers):
            if len(at["id"]):
                yield by_doc(at["id"], at["rk"], {k: at[k] for k in answer})

    there = df.mapInArrow(sending, "bucket int, " + ", ".join(f"{k} binary" for k in names | own)).repartition(tasks, "bucket")
    back = there.mapInArrow(receiving, "bucket int, " + ", ".join(f"{k} binary" for k in answers)).repartition(tasks, "bucket")
    return back.mapInArrow(gathering, f"{DOCS}, " + ", ".join(f"{k} binary" for k in answer))


def _by_bucket(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[dict[str, np.ndarray]]:
    """All values of one bucket after another; the task holds its buckets packed."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        for i, b in enumerate(batch.column(0).to_pylist()):
            held.setdefault(b, []).append(batch.slice(i, 1))
    while held:
        _, rows = held.popitem()
        yield {k: np.concatenate([unpacked(r.column(j), t) for r in rows]) for j, (k, t) in enumerate(kinds.items(), 1)}


class Answers:
    """The positions that the documents of a batch have got."""

    def __init__(self, batch: pa.RecordBatch, name: str):
        self.offs, self.data = buffers(batch.column(batch.schema.get_field_index(name)))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.data[self.offs[i] : self.offs[i + 1]].view(np.int64)


def first_of(keys: list[np.ndarray], at: dict[str, np.ndarray]) -> np.ndarray:
    """Which entries are the earliest of their key, in the order of (id, rk, pos)."""
    order, starts = groups(keys)
    place = (rank(at["id"], at["rk"]) << np.uint64(32)) | at["pos"].astype(np.uint64)
    least = np.minimum.reduceat(place[order], starts)
    sizes = np.diff(np.append(starts, len(order)))
    out = np.empty(len(order), bool)
    out[order] = place[order] == np.repeat(least, sizes)
    return out


def later_windows(df: DataFrame, windows: Callable, tasks: int) -> DataFrame:
    """windows: from batches to entries h1, h2, id, rk, pos.  Answers ``later``: starts of windows that also start earlier."""

    def settle(at: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
        first = first_of([at["h1"], at["h2"]], at)
        return first, {"id": at["id"][~first], "rk": at["rk"][~first], "later": at["pos"][~first]}

    def send(batches):
        for at in windows(batches):
            first, settled = settle(at)
            yield {k: v[first] for k, v in at.items()}, settled

    return exchange(df, send, lambda at: settle(at)[1], {"h1": np.uint64, "h2": np.uint64, "pos": np.int32}, ("later",), tasks)


def answered(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Documents with their answers; the answers are built into hash tables, so texts aren't sorted."""
    return docs.join(found.hint("shuffle_hash"), ["id", "rk"], how)


def covered(size: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of size places lie in a window of that width that starts at one of starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0
