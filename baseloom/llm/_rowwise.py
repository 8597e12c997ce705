"""Columns computed in Python beside all columns of a table, whatever their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beside(df: DataFrame, text_col: str, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: str) -> DataFrame:
    """df's columns and those that compute gives for a batch with the column ``text``.

    Added columns replace columns of the same names.
    """
    new = T._parse_datatype_string(added) if isinstance(added, str) else added
    kept = [f for f in df.schema.fields if f.name not in new.fieldNames()]
    inner = df.select(*(F.col(f"`{f.name}`").alias(f"p{i}") for i, f in enumerate(kept)), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(f"p{i}", f.dataType, True) for i, f in enumerate(kept)] + new.fields)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = compute(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(got[f.name] for f in new.fields)], names=schema.fieldNames())

    out = inner.mapInArrow(run, schema)
    return out.select(*(F.col(f"p{i}").alias(f.name) for i, f in enumerate(kept)), *new.fieldNames())
