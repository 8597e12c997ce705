"""Hits as Arrow IPC streams, and how the columns of their Parquet files are encoded."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: By encoding the kinds of columns that it fits.
ENCODINGS = {
    "dict": (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType),
    "plain": (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType),
    "delta": (T.IntegralType,),
    "delta-text": (T.StringType,),
}


def encoding_options(schema: T.StructType, encodings: dict[str, str]) -> dict[str, str]:
    """Options of the Parquet writer: a dictionary or none for each column, and pages of the second version, which write deltas where there is no dictionary.

    An unknown column, or an encoding that doesn't fit its type, is an error before
    anything is written.  What isn't named keeps its dictionary.
    """
    out = {}
    for column, encoding in encodings.items():
        if encoding not in ENCODINGS:
            raise ValueError(f"no encoding {encoding!r}; there are {', '.join(ENCODINGS)}")
        if column not in schema.fieldNames():
            raise ValueError(f"no column {column!r} to encode")
        if not isinstance(schema[column].dataType, ENCODINGS[encoding]):
            raise ValueError(f"column {column!r} of type {schema[column].dataType.simpleString()} can't be encoded as {encoding}")
        out[f"parquet.enable.dictionary#{column}"] = str(encoding == "dict").lower()
    if any(e.startswith("delta") for e in encodings.values()):
        out["parquet.writer.version"] = "PARQUET_2_0"
    return out


def stream_to(rows: DataFrame, sink, batch_rows: int = 65_536) -> int:
    """Writes one Arrow IPC stream, with its end mark, to an open sink such as a pipe, partition by partition; gives the number of rows."""
    schema, n = to_arrow_schema(rows.schema), 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, schema) as writer:
                    writer.write_batch(batch.slice(at, batch_rows).cast(schema))
                yield pa.RecordBatch.from_pydict({"stream": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    with pa.ipc.new_stream(sink, schema) as writer:
        for row in rows.mapInArrow(packed, "stream binary").toLocalIterator():
            for batch in pa.ipc.open_stream(row["stream"]):
                writer.write_batch(batch)
                n += batch.num_rows
    return n


def write_streams(rows: DataFrame, path: str) -> list[str]:
    """An Arrow IPC stream for each partition, in a folder that all tasks can write; gives their names, in order."""
    from baseloom.sources.alignments import open_store

    schema = to_arrow_schema(rows.schema)
    store, folder = open_store(path)
    store.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.arrows"
        draft = f"{name}.{uuid4().hex}"
        with store.open_output_stream(draft) as sink, pa.ipc.new_stream(sink, schema) as writer:
            for batch in batches:
                writer.write_batch(batch.cast(schema))
        store.move(draft, name)  # whole, or not there
        yield pa.RecordBatch.from_pydict({"name": [name]})

    return sorted(r["name"] for r in rows.mapInArrow(run, "name string").collect())
