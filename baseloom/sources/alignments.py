"""SAM and BAM as DataFrames.

SAM text is read with Spark's text reader, so its splits are read in parallel and any
store that Spark reads will do; record numbers come from the order of files and lines.
BAM files are cut in splits of compressed bytes.  A split looks for its first block and
its first record; the place where the split before it ends confirms what it found, or
corrects it.  Splits are counted on the way, so records are numbered through all files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TAGS = "map<string,struct<type:string,value:string>>"
SCHEMA = f"record_id bigint, qname string, flags int, tid int, ref_name string, pos bigint, mapq smallint, cigar string, mate_tid int, mate_ref_name string, mate_pos bigint, insert_size bigint, seq string, qual string, quals array<int>, tags {TAGS}"
SEQ = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"


def header(spark: SparkSession, path: str) -> str:
    """The header lines of SAM text."""
    rows = spark.read.text(path).filter(F.col("value").startswith("@")).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).orderBy("file", "at")
    return "\n".join(r.value for r in rows.collect())


def contigs(text: str) -> list[tuple[str, int, str | None]]:
    """(name, length, M5) of the @SQ lines, in order."""
    out = []
    for line in text.splitlines():
        if line.startswith("@SQ\t"):
            fields = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
            out.append((fields["SN"], int(fields["LN"]), fields.get("M5")))
    return out


def parse_sam(lines: DataFrame, names: list[str]) -> DataFrame:
    """lines: (record_id, value).  names: contigs in the header's order."""
    f = F.split("value", "\t")
    order = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i)))) if names else F.create_map().cast("map<string,int>")
    get = lambda i: F.get(f, F.lit(i))
    ref = F.nullif(get(2), F.lit("*"))
    mate = F.when(get(6) == "=", ref).otherwise(F.nullif(get(6), F.lit("*")))
    aux = F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.struct(F.substring(t, 4, 1).alias("type"), F.regexp_replace(t, "^.....", "").alias("value")).alias("v")))
    first = F.filter(aux, lambda t, i: ~F.exists(F.slice(aux, 1, i), lambda u: u["k"] == t["k"]))  # of a repeated tag the first counts
    qual = get(10)
    return lines.select(
        "record_id", get(0).alias("qname"), get(1).cast("int").alias("flags"), F.coalesce(F.try_element_at(order, ref), F.lit(-1)).alias("tid"), ref.alias("ref_name"), (get(3).cast("bigint") - 1).alias("pos"), get(4).cast("smallint").alias("mapq"), get(5).alias("cigar"),
        F.coalesce(F.try_element_at(order, mate), F.lit(-1)).alias("mate_tid"), mate.alias("mate_ref_name"), (get(7).cast("bigint") - 1).alias("mate_pos"), get(8).cast("bigint").alias("insert_size"), get(9).alias("seq"), F.nullif(qual, F.lit("*")).alias("qual"),
        F.when(qual != "*", F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)).alias("quals"), F.map_from_entries(F.transform(first, lambda t: F.struct(t["k"], t["v"]))).alias("tags"),
    )


def numbered(lines: DataFrame) -> DataFrame:
    """Adds record_id: dense, in the order of files and of lines in them.

    Splits are counted first, by file and start; the sums before each are broadcast, and
    lines are numbered where they are read, so nothing but the counts is shuffled.
    """
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("n")).orderBy("file", "start").collect()
    before, total = {}, 0
    for r in counts:
        before[r["file"], r["start"]] = total
        total += r["n"]
    shared = lines.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], int] = {}
        for batch in batches:
            keys = pa.StructArray.from_arrays([batch.column(1), batch.column(2)], ["file", "start"])
            # a task may read several splits, one after another
            file, start = batch.column(1).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
            new = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
            cuts = np.concatenate([[0], new, [batch.num_rows]]) if batch.num_rows else np.zeros(1, np.int64)
            out = np.zeros(batch.num_rows, np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = keys[lo].as_py()
                at = own["file"], own["start"]
                first = shared.value[at] + done.get(at, 0)
                out[lo:hi] = np.arange(first, first + hi - lo)
                done[at] = done.get(at, 0) + hi - lo
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(0)], names=["record_id", "value"])

    return lines.select("value", "file", "start").mapInArrow(run, "record_id bigint, value string")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).filter(~F.col("value").startswith("@") & (F.length("value") > 0))
    return parse_sam(numbered(lines), [n for n, _, _ in contigs(header(spark, path))])


# BAM


def bgzf_blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, contents) of each compressed block."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"not a BGZF block at byte {at}")
        extra, size, i = struct.unpack_from("<H", data, at + 10)[0], None, at + 12
        while i < at + 12 + extra:
            tag, n = data[i : i + 2], struct.unpack_from("<H", data, i + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", data, i + 4)[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError(f"no block size at byte {at}")
        yield at, zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
        at += size


def bam_header(body: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """(text, contigs, where records begin)."""
    if body[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", body, 4)[0]
    text, at = body[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
    count, at, refs = struct.unpack_from("<i", body, at)[0], at + 4, []
    for _ in range(count):
        n = struct.unpack_from("<i", body, at)[0]
        name = body[at + 4 : at + 3 + n].decode()
        refs.append((name, struct.unpack_from("<i", body, at + 4 + n)[0]))
        at += 8 + n
    return text, refs, at


_SIZES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}


def aux_tags(data: bytes) -> dict[str, tuple[str, str]]:
    """Tags by name, the first of each; what follows damage is left out."""
    out, at = {}, 0
    try:
        while at + 3 <= len(data):
            tag, kind, at = data[at : at + 2].decode("ascii"), chr(data[at + 2]), at + 3
            if kind in "ZH":
                end = data.index(b"\0", at)
                value, at = data[at:end].decode(), end + 1
            elif kind == "B":
                sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
                form = "<" + str(n) + _SIZES[sub]
                value, at = ",".join(map(_shown, struct.unpack_from(form, data, at + 5))), at + 5 + struct.calcsize(form)
            else:
                form = "<" + _SIZES[kind]
                got = struct.unpack_from(form, data, at)[0]
                value, at = got.decode() if kind == "A" else _shown(got), at + struct.calcsize(form)
            out.setdefault(tag, (kind, value))
    except (KeyError, ValueError, struct.error, UnicodeDecodeError):
        pass
    return out


def _shown(x) -> str:
    return format(x, "g") if isinstance(x, float) else str(x)


def bam_record(data: bytes, refs: list[tuple[str, int]]) -> tuple:
    tid, pos, name_len, mapq, _, n_cigar, flags, n_seq, mate_tid, mate_pos, size = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    qname, at = data[at : at + name_len - 1].decode(), at + name_len
    ops, at = struct.unpack_from(f"<{n_cigar}I", data, at), at + 4 * n_cigar
    packed, at = data[at : at + (n_seq + 1) // 2], at + (n_seq + 1) // 2
    quals, at = data[at : at + n_seq], at + n_seq
    seq = "".join(SEQ[b >> 4] + SEQ[b & 15] for b in packed)[:n_seq]
    known = bool(quals) and quals[0] != 0xFF
    ref = refs[tid][0] if tid >= 0 else None
    mate = refs[mate_tid][0] if mate_tid >= 0 else None
    tags = {k: {"type": t, "value": v} for k, (t, v) in aux_tags(data[at:]).items()}
    cigar = "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*"
    return (qname, flags, tid, ref, pos, mapq, cigar, mate_tid, mate, mate_pos, size, seq or "*", "".join(chr(q + 33) for q in quals) if known else None, list(quals) if known else None, tags)


def bam_records(body: bytes, refs, at: int) -> Iterator[tuple]:
    while at + 4 <= len(body):
        n = struct.unpack_from("<i", body, at)[0]
        yield bam_record(body[at + 4 : at + 4 + n], refs)
        at += 4 + n


#: Compressed bytes of a split.
SPLIT = 32 << 20
#: A block holds no more than this, compressed or not.
MOST_BLOCK = 1 << 16


@dataclass(frozen=True)
class Split(InputPartition):
    """Records that begin in blocks from begin to end of a file; at (block, offset in it) if that is known."""

    path: str
    begin: int
    end: int
    at: tuple[int, int] | None = None
    first_id: int = 0

    def __hash__(self):
        return hash((self.path, self.begin))


class BlockFile:
    """A BGZF file, of any store that Arrow opens, from some place on."""

    def __init__(self, path: str):
        store, name = open_store(path)
        self.file = store.open_input_file(name)
        self.size = self.file.size()

    def bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def block(self, at: int) -> tuple[bytes, int]:
        """(contents, compressed size) of the block at a place; (b"", 0) behind the last one."""
        data = self.bytes(at, MOST_BLOCK + 1)
        if not data:
            return b"", 0
        size = block_size(data, 0)
        if size is None:
            raise ValueError(f"not a BGZF block at byte {at}")
        return zlib.decompress(data[12 + struct.unpack_from("<H", data, 10)[0] : size - 8], -15), size

    def next_block(self, at: int) -> int:
        """Where the first block at or behind a place begins: one that others follow, to the end or for a while."""
        data = self.bytes(at, 4 * MOST_BLOCK)
        k = data.find(BLOCK_MARK)
        while k >= 0:
            here, n = k, 0
            while here < len(data) and n < 3 and (size := block_size(data, here)):
                here, n = here + size, n + 1
            if n == 3 or at + here == self.size:
                return at + k
            k = data.find(BLOCK_MARK, k + 1)
        return self.size


def open_store(path: str):
    """(file system, path in it) by Arrow; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9+]+:", path) else (fs.LocalFileSystem(), path)


BLOCK_MARK = b"\x1f\x8b\x08\x04"


def block_size(data: bytes, at: int) -> int | None:
    if data[at : at + 4] != BLOCK_MARK or at + 18 > len(data):
        return None
    stop, i = at + 12 + struct.unpack_from("<H", data, at + 10)[0], at + 12
    while i + 4 <= min(stop, len(data)):
        n = struct.unpack_from("<H", data, i + 2)[0]
        if data[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(data):
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + n
    return None


def bam_start(path: str) -> tuple[str, list[tuple[str, int]], tuple[int, int]]:
    """(header text, contigs, (block, offset) of the first record)."""
    file, body, sizes, at = BlockFile(path), b"", [], 0
    while True:
        data, size = file.block(at)
        if not size:
            raise ValueError(f"{path}: the header is cut off")
        sizes.append((at, len(body)))
        body, at = body + data, at + size
        try:
            text, refs, stop = bam_header(body)
        except (struct.error, IndexError):
            continue
        if stop <= len(body):
            block, begin = max(x for x in sizes if x[1] <= stop)
            return text, refs, (block, stop - begin) if stop < len(body) else (at, 0)


def _plausible(body: bytes, at: int, contigs: int) -> int | None:
    """The length of what may be a record at a place; None if it can't be one."""
    if at + 36 > len(body):
        return None
    size, tid, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", body, at)
    if not (-1 <= tid < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and name >= 1 and bases >= 0):
        return None
    if size < 32 + name + 4 * ops + (bases + 1) // 2 + bases or body[at + 35 + name : at + 36 + name] not in (b"\0", b""):
        return None
    return size + 4


def find_record(file: BlockFile, at: int, contigs: int) -> tuple[int, int] | None:
    """(block, offset) of the first record that begins in blocks from a place on, as far as can be told; None without any."""
    block = at
    while block < file.size:
        body, places, here = b"", [], block
        while len(body) < 4 * MOST_BLOCK:
            data, size = file.block(here)
            if not size:
                break
            places.append((here, len(body)))
            body, here = body + data, here + size
        first_size = places[1][1] if len(places) > 1 else len(body)
        for start in range(first_size):
            k, n = start, 0
            while k < len(body) and n < 6 and (size := _plausible(body, k, contigs)):
                k, n = k + size, n + 1
            if n == 6 or n and (k == len(body) and here >= file.size or n >= 2 and k > len(body)):
                return block, start
        block += file.block(block)[1]
    return None


def split_records(split: Split, contigs: int) -> Iterator[tuple[int, int, bytes]]:
    """(block, offset, record) of the records that begin in a split, and at the end one without a record: where the next begins."""
    file = BlockFile(split.path)
    at = split.at or find_record(file, file.next_block(split.begin), contigs)
    if at is None:
        yield file.size, 0, b""
        return
    block, offset = at
    body, size = file.block(block)
    starts, after = [(0, block)], block + size  # where blocks begin in body
    while True:
        while offset >= len(body) or len(body) < offset + 4 or len(body) < offset + 4 + struct.unpack_from("<i", body, offset)[0]:
            data, size = file.block(after)
            if not size:
                break
            starts.append((len(body), after))
            body, after = body + data, after + size
        begin, block = max(x for x in starts if x[0] <= offset)
        if offset >= len(body) or block >= split.end:
            yield (block, offset - begin, b"") if offset < len(body) else (file.size, 0, b"")
            return
        n = struct.unpack_from("<i", body, offset)[0]
        if offset + 4 + n > len(body):
            raise ValueError(f"{split.path}: the last record is cut off")
        yield block, offset - begin, body[offset + 4 : offset + 4 + n]
        offset += 4 + n
        if offset > 1 << 20:
            cut = max(x[0] for x in starts if x[0] <= offset)
            body, offset, starts = body[cut:], offset - cut, [(x - cut, b) for x, b in starts if x >= cut]


def counted_splits(spark: SparkSession, paths: list[str], split: int = SPLIT) -> tuple[list[Split], list[list[tuple[str, int]]]]:
    """(splits with where they begin and the number of their first record, contigs of each file).

    A split that begins elsewhere than the one before it ends is counted again from there.
    """
    out, contigs = [], []
    for path in paths:
        _, refs, at = bam_start(path)
        contigs.append(refs)
        size = BlockFile(path).size
        cuts = [at[0], *range(at[0] + split, size, split), size]
        out += [Split(path, a, b, at if a == at[0] else None) for a, b in zip(cuts, cuts[1:])]
    of = {p: len(c) for p, c in zip(paths, contigs, strict=True)}

    def facts(s: Split) -> tuple[tuple[int, int] | None, tuple[int, int], int]:
        first, n = None, 0
        for block, offset, record in split_records(s, of[s.path]):
            first = first or (block, offset)
            if record:
                n += 1
        return first, (block, offset), n

    def counts(batches):
        for batch in batches:
            for path, begin, end, block, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, last, n = facts(Split(path, begin, end, None if block is None else (block, offset)))
                yield pa.RecordBatch.from_pylist([{"path": path, "begin": begin, "b": first[0], "o": first[1], "eb": last[0], "eo": last[1], "n": n}], COUNTS)

    COUNTS = pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("begin", "b", "o", "eb", "eo", "n"))])
    rows = [(s.path, s.begin, s.end, *(s.at or (None, None))) for s in out]
    frame = spark.createDataFrame(rows, "path string, begin bigint, end bigint, b bigint, o bigint").repartition(max(1, len(rows)), "path", "begin")
    found = {(r.path, r.begin): r for r in frame.mapInArrow(counts, "path string, begin bigint, b bigint, o bigint, eb bigint, eo bigint, n bigint").collect()} if rows else {}
    done, total, expected = [], 0, None
    for s in out:
        r = found[s.path, s.begin]
        first, last, n = (r.b, r.o), (r.eb, r.eo), r.n
        if done and done[-1].path == s.path and first != expected:
            if expected[0] >= s.end:  # one record fills the whole split
                first, last, n = expected, expected, 0
            else:
                first, last, n = facts(replace(s, at=expected))
        done.append(replace(s, at=first, first_id=total))
        total, expected = total + n, last
    return [s for s in done if s.at[0] < s.end], contigs


NAMES = [c.split()[0] for c in SCHEMA.replace(TAGS, "tags_").split(", ")]


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: files of stores that Arrow opens, a task for each split."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options, [f.name for f in schema.fields])


class BamReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.paths, self.columns = bam_paths(options["path"]), columns
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        if spark is None:  # planned outside the driver: a split for each file, counted here
            out, total = [], 0
            for path in self.paths:
                _, refs, at = bam_start(path)
                whole = Split(path, at[0], BlockFile(path).size, at, total)
                out.append(whole)
                total += sum(bool(r) for *_, r in split_records(whole, len(refs))) if len(self.paths) > 1 else 0
            return out
        return counted_splits(spark, self.paths, self.split)[0]

    def read(self, partition: Split) -> Iterator[tuple]:
        keep = [NAMES.index(c) for c in self.columns]
        for row in numbered_records(partition):
            yield tuple(row[i] for i in keep)


def bam_paths(path: str) -> list[str]:
    """Files by path, pattern or folder, sorted; none is an error."""
    from glob import glob
    from pathlib import Path

    plain = path.removeprefix("file://")
    if re.match(r"^[a-z0-9+]+:", plain):
        return [plain]
    found = sorted(str(p) for p in Path(plain).glob("*.bam")) if Path(plain).is_dir() else sorted(glob(plain))
    if not found:
        raise FileNotFoundError(f"no file at {path}")
    return found


def numbered_records(split: Split) -> Iterator[tuple]:
    refs = bam_start(split.path)[1]
    k = split.first_id
    for _, _, record in split_records(split, len(refs)):
        if record:
            yield (k, *bam_record(record, refs))
            k += 1


def read_bam(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """BAM files, read by splits; records are numbered densely, in the order of files and of records in them."""
    splits, _ = counted_splits(spark, [x for p in paths for x in bam_paths(p)], split)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, begin, end, block, offset, first in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                rows = []
                for r in numbered_records(Split(path, begin, end, (block, offset), first)):
                    rows.append(r)
                    if len(rows) == 5_000:
                        yield pd.DataFrame(rows, columns=NAMES)
                        rows = []
                yield pd.DataFrame(rows, columns=NAMES)

    rows = [(s.path, s.begin, s.end, *s.at, s.first_id) for s in splits]
    frame = spark.createDataFrame(rows, "path string, begin bigint, end bigint, block bigint, offset bigint, first bigint")
    return frame.repartition(max(1, len(rows)), "path", "begin").mapInPandas(run, SCHEMA)


def bam_bytes(text: str, refs: list[tuple[str, int]]) -> bytes:
    """A BAM file up to its records."""
    out = bytearray(b"BAM\x01" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(refs)))
    for name, length in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return bytes(out)


def record_bytes(row) -> bytes:
    """A record as BAM has it; row: a mapping with the columns of SCHEMA."""
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [SEQ.index(c) for c in seq] + [0] * (len(seq) % 2)
    ops = [int(n) << 4 | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    out = struct.pack("<iiBBHHHiiii", row["tid"], row["pos"], len(row["qname"]) + 1, row["mapq"], 0, len(ops), row["flags"], len(seq), row["mate_tid"], row["mate_pos"], row["insert_size"])
    out += row["qname"].encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    out += bytes(row["quals"]) if row["quals"] is not None and len(row["quals"]) else b"\xff" * len(seq)
    for tag, v in dict(row["tags"] or {}).items():
        kind, value = v["type"], v["value"]
        out += tag.encode() + kind.encode()
        if kind in "ZH":
            out += value.encode() + b"\0"
        elif kind == "A":
            out += value.encode()
        elif kind == "B":
            sub, _, rest = value.partition(",") if value[:1].isalpha() else ("i", "", value)
            xs = [float(x) if sub == "f" else int(x) for x in rest.split(",")] if rest else []
            out += sub.encode() + struct.pack(f"<i{len(xs)}{_SIZES[sub]}", len(xs), *xs)
        else:
            out += struct.pack("<" + _SIZES[kind], float(value) if kind in "fd" else int(value))
    return struct.pack("<i", len(out)) + out


def compressed(data: bytes) -> bytes:
    return b"".join(_bgzf(data[at : at + 60_000]) for at in range(0, len(data), 60_000))


def _bgzf(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def sam_lines(reads: DataFrame) -> DataFrame:
    """(record_id, value): records as SAM text, in no order; sort by record_id before writing."""
    tag = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit(":"), F.when(e["value"]["type"].isin(*"cCsSI"), "i").otherwise(e["value"]["type"]), F.lit(":"), e["value"]["value"]))
    star = lambda c: F.coalesce(c, F.lit("*"))
    mate = F.when(F.col("mate_ref_name") == F.col("ref_name"), "=").otherwise(star(F.col("mate_ref_name")))
    parts = ["qname", F.col("flags").cast("string"), star(F.col("ref_name")), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), star(F.col("cigar")), mate, (F.col("mate_pos") + 1).cast("string"), F.col("insert_size").cast("string"), star(F.col("seq")), star(F.col("qual"))]
    return reads.select("record_id", F.array_join(F.concat(F.array(*parts), tag), "\t").alias("value"))


def with_program(header: str, name: str, version: str, command: str = "") -> str:
    """The header with a @PG line more, which points to the last one before it."""
    ids = [f[3:] for line in header.splitlines() if line.startswith("@PG\t") for f in line.split("\t")[1:] if f.startswith("ID:")]
    own, k = name, 0
    while own in ids:
        k += 1
        own = f"{name}.{k}"
    fields = [f"ID:{own}", f"PN:{name}", f"VN:{version}", *([f"PP:{ids[-1]}"] if ids else []), *([f"CL:{command}"] if command else [])]
    return "\n".join([*(line for line in header.splitlines() if line), "\t".join(["@PG", *fields])])


def header_of(refs: list[tuple[str, int, str | None]]) -> str:
    """A header with contigs, in order."""
    return "\n".join(["@HD\tVN:1.6\tSO:unknown", *("\t".join([f"@SQ\tSN:{n}", f"LN:{k}", *([f"M5:{m}"] if m else [])]) for n, k, m in refs)])


def write_sam(reads: DataFrame, path: str, header: str = "", single: bool = False) -> None:
    """SAM text in input order, after its header: sorted parts whose names are in order, or all in one."""
    from baseloom.sinks.sites import join_parts
    from baseloom.sources.manifest import write_text

    sam_lines(reads).orderBy("record_id").select("value").write.mode("overwrite").text(path)
    if header:
        write_text(reads.sparkSession, f"{path.rstrip('/')}/part-00000--header.txt", header.rstrip("\n") + "\n")
    if single:
        join_parts(reads.sparkSession, path)


def write_bam(reads: DataFrame, path: str, header: str) -> None:
    """One BAM file in input order.

    Tasks sort and compress their share beside the path; compressed blocks may follow one
    another, so the driver only streams the parts together.
    """
    refs = [(n, k) for n, k, _ in contigs(header)]
    work = f"{path}.parts-{uuid4().hex}"
    store, folder = open_store(work)
    store.create_dir(folder)
    ordered = reads.repartitionByRange("record_id").sortWithinPartitions("record_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = open_store(work)
        name = f"{folder}/{task.partitionId():08d}"
        part, held = f"{name}.{task.taskAttemptId()}", bytearray()
        with store.open_output_stream(part) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    held += record_bytes(row)
                    if len(held) >= 1 << 20:
                        out.write(compressed(bytes(held)))
                        held = bytearray()
            if held:
                out.write(compressed(bytes(held)))
        store.move(part, name)  # a repeated attempt writes the same
        yield pa.RecordBatch.from_pydict({"part": [name]})

    parts = sorted(r.part for r in ordered.mapInArrow(run, "part string").collect())
    store, name = open_store(path)
    with store.open_output_stream(name) as out:
        out.write(compressed(bam_bytes(header.rstrip("\n") + "\n", refs)))
        for part in parts:
            with store.open_input_stream(part) as source:
                while data := source.read(1 << 20):
                    out.write(data)
        out.write(_bgzf(b""))
    store.delete_dir(folder)
