"""Files of hits: encodings, streams, manifests and stored queries."""

import io

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from baseloom.sinks import hits as sinks
from baseloom.sources import manifest as M


@pytest.fixture
def rows(spark):
    return spark.range(3000).select((F.col("id") * 3).alias("refr_pos"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("qname"), (F.col("id") % 2).cast("smallint").alias("qual"), F.array(F.lit(1), F.col("id").cast("int")).alias("cols")).repartition(3)


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


def test_encodings(spark, rows, tmp_path):
    flat = rows.drop("cols")
    path = str(tmp_path / "hits")
    M.write_hits(flat, path, encodings={"refr_pos": "delta", "qname": "delta-text", "qual": "dict"})
    file = next((tmp_path / "hits").glob("part-*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    used = {group.column(i).path_in_schema: set(group.column(i).encodings) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in used["refr_pos"] and "DELTA_BYTE_ARRAY" in used["qname"] and "RLE_DICTIONARY" in used["qual"]
    assert same(M.read_hits(spark, path).collect(), flat.collect())
    (tmp_path / "hits" / "note.txt").write_text("not a part")
    assert M.write_hits(flat, path)["replaced"] == ["note.txt"]
    for bad in ({"refr_pos": "delta-text"}, {"qname": "delta"}, {"none": "dict"}, {"qname": "gzip"}):
        with pytest.raises(ValueError):
            sinks.encoding_options(flat.schema, bad)


def test_streams(spark, rows, tmp_path):
    sink = io.BytesIO()
    assert sinks.stream_to(rows, sink, batch_rows=500) == 3000
    table = pa.ipc.open_stream(sink.getvalue()).read_all()
    assert same([tuple(r.values()) for r in table.to_pylist()], [tuple(r) for r in rows.collect()])
    assert sinks.stream_to(rows.limit(0), io.BytesIO()) == 0
    names = sinks.write_streams(rows, str(tmp_path / "streams"))
    parts = [pa.ipc.open_stream(pa.OSFile(n)).read_all() for n in names]
    assert len(names) == 3 and sum(p.num_rows for p in parts) == 3000 and parts[0].schema.names == rows.columns


def test_manifests_by_pattern(spark, rows, tmp_path):
    for k in range(2):
        M.write_hits(rows.filter(f"refr_pos % 2 = {k}"), str(tmp_path / f"run{k}"))
    assert M.read_hits(spark, str(tmp_path / "run*")).count() == 3000
    with pytest.raises(FileNotFoundError):
        M.read_hits(spark, str(tmp_path / "other*"))


def test_stored_queries():
    old, new = '[query.a]\nread = "C"\nrefr = "C"', '[query.b]\nread = "T"\nrefr = "C"'
    head = "\n".join(["@PG\tID:r1", "@PG\tID:r2\tPP:r1", *M.comment_lines("new.toml", new, "r2"), *M.comment_lines("old.toml", old, "r1")])
    assert [run for run, *_ in M.stored_files(head)] == ["r1", "r2"]
    assert list(M.queries_for(head).queries) == ["b"] and list(M.queries_for(head, old).queries) == ["a"] and M.dumped(head, "r1") == f"# old.toml\n{old}"
    with pytest.raises(ValueError, match="no query file"):
        M.dumped("@HD\tVN:1.6")
