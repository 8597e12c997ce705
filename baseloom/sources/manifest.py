"""What a run leaves beside its hits: a manifest, written last, and queries kept in headers."""

from __future__ import annotations

import json
import tomllib
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

FORMAT = "10"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_hits(rows: DataFrame, path: str, query_text: str = "", small: bool = False, encodings: dict[str, str] | None = None, **facts) -> dict:
    """Hits as Parquet, then the manifest: a folder without one isn't complete.

    Files that don't belong to the new hits go with the old ones; their names are in the
    manifest as ``replaced``.  encodings: by column, see ``sinks.hits``.
    """
    from baseloom.sinks.hits import encoding_options

    spark = rows.sparkSession
    manifest_path = f"{path.rstrip('/')}.manifest.json"
    p, fs = _path(spark, manifest_path)
    fs.delete(p, False)
    folder, _ = _path(spark, path)
    replaced = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    writer = rows.write.mode("overwrite").option("compression", "zstd" if small else "lz4_raw")
    writer.options(**encoding_options(rows.schema, encodings or {})).parquet(path)
    manifest = {
        "format_version": FORMAT, "coordinate_base": 0, "run_id": uuid.uuid4().hex, "written": datetime.now(UTC).isoformat(),
        "columns": rows.columns, "query": query_text, "replaced": [n for n in replaced if not n.startswith(("part-", "_SUCCESS", "."))],
    }
    manifest |= facts
    write_text(spark, manifest_path, json.dumps(manifest))
    return manifest


def expand(spark: SparkSession, *patterns: str) -> list[str]:
    """Paths that match, sorted, each once; a pattern that matches nothing is an error."""
    out = set()
    for pattern in patterns:
        p, fs = _path(spark, pattern)
        found = [s.getPath().toString() for s in fs.globStatus(p) or [] if not s.getPath().getName().endswith(".manifest.json")]
        if not found:
            raise FileNotFoundError(f"nothing matches {pattern}")
        out |= set(found)
    return sorted(out)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest beside hits; an incomplete run has none, which is an error."""
    text = spark.read.text(f"{path.rstrip('/')}.manifest.json", wholetext=True).first()
    if text is None:
        raise ValueError(f"{path}: no manifest")
    return json.loads(text[0])


def query_names(manifest: dict) -> list[str]:
    return list(tomllib.loads(manifest.get("query", "")).get("query", {}))


def read_hits(spark: SparkSession, *paths: str) -> DataFrame:
    """Hits of complete runs, by path or pattern; unsigned integers come as signed ones."""
    paths = expand(spark, *paths)
    bases = {read_manifest(spark, p).get("coordinate_base", 0) for p in paths}
    if len(bases) > 1:
        raise ValueError(f"hits count positions from different bases: {sorted(bases)}")
    rows = spark.read.parquet(*paths)
    wide = {f.name: "bigint" for f in rows.schema.fields if f.dataType.simpleString() == "decimal(20,0)"}
    return rows.withColumns({n: rows[n].cast(t) for n, t in wide.items()}) if wide else rows


# Query files in an alignment header, as comment lines

MARK = "baseloom"


def comment_lines(name: str, text: str, run: str) -> list[str]:
    """``@CO`` lines that hold a file: its name and number of lines, then each line."""
    lines = text.splitlines()
    quoted = [json.dumps(x)[1:-1] for x in lines]
    return [f"@CO\t{MARK}:v1:file\t{run}\t{name}\t{len(lines)}", *(f"@CO\t{MARK}:v1:line\t{run}\t{x}" for x in quoted)]


def stored_files(header: str) -> list[tuple[str, str, str]]:
    """(run, name, text) of the files in a header, in the order of their runs' @PG lines, then of the lines; a cut-off one is an error."""
    out, open_ = [], None
    programs = [f[3:] for line in header.splitlines() if line.startswith("@PG\t") for f in line.split("\t") if f.startswith("ID:")]
    for line in header.splitlines():
        kind, _, rest = line.partition("\t")
        if kind != "@CO" or not rest.startswith(f"{MARK}:v1:"):
            continue
        what, *fields = rest.split("\t")
        if what.endswith(":file"):
            open_ = [fields[0], fields[1], int(fields[2]), []]
            out.append(open_)
        elif open_:
            open_[3].append(json.loads(f'"{fields[1]}"') if len(fields) > 1 else "")
    for run, name, n, lines in out:
        if len(lines) != n:
            raise ValueError(f"{name} of run {run} has {len(lines)} of {n} lines in the header")
    out.sort(key=lambda x: programs.index(x[0]) if x[0] in programs else -1)  # stable: lines keep their order
    return [(run, name, "\n".join(lines)) for run, name, n, lines in out]


def dumped(header: str, run: str | None = None) -> str:
    """The query files of a run, the newest if none is named, as one text."""
    files = stored_files(header)
    wanted = run or (files[-1][0] if files else None)
    texts = [f"# {name}\n{text}" for r, name, text in files if r == wanted]
    if not texts:
        raise ValueError("the header holds no query file" + (f" of run {run}" if run else ""))
    return "\n\n".join(texts)


def queries_for(header: str, query_file: str | None = None):
    """What a tag is read back with: the file that is given, else those of the newest run in the header."""
    from baseloom.operators.patterns import load

    return load(query_file) if query_file is not None else load(dumped(header))
