"""The column walk: an alignment as aligned columns of read and reference.

A column has the codesets that read and reference show (rd, rf), the 0-based reference
position, the offset in the read in walk order, and the base quality.  The walk follows
the strand that the read reports on, so for the bottom strand both sides are complemented
and positions fall.  The records of an Arrow batch are walked together, as NumPy arrays
that are cut at records; what uses the columns (matching, tags, concordance) runs on the
same arrays, so columns reach the JVM only when ``walk`` is asked for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baseloom.functions import codes as K

COLUMN = "struct<rd:int,rf:int,pos:bigint,off:bigint,q:int>"
#: References up to so many bases in all are broadcast; larger ones are joined by tiles.
BROADCAST_BASES = 64 << 20
#: Bases of the smallest tiles, how much larger those of each next level are, and levels; a tile shows a quarter more behind its own bases.
TILE, LARGER, LEVELS = 1 << 12, 16, 6
#: Bytes of tiles in a batch.
TILES_BYTES = 4 << 20
#: Bases that are walked at once, so that their arrays stay in a core's cache.
PIECE = 1 << 16


def cigar_ops(cigar: Column) -> Column:
    """Array of (op, n)."""
    n = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), 1), lambda x: x.cast("bigint"))
    op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), 2)
    return F.coalesce(F.zip_with(op, n, lambda o, k: F.struct(o.alias("op"), k.alias("n"))), F.array().cast("array<struct<op:string,n:bigint>>"))


def reference_length(cigar: Column) -> Column:
    spans = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1)
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, n: a + n.cast("bigint"))


def _length_of(cigar: Column, pattern: str) -> Column:
    """The length in a pattern's first group; 0 where the pattern isn't found."""
    return F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("bigint"), F.lit(0))


#: Clips at the start and at the end of a CIGAR, hard ones outside.
_CLIPS = {("hard", 0): r"^(\d+)H", ("soft", 0): r"^(?:\d+H)?(\d+)S", ("hard", 1): r"[A-Z=](\d+)H$", ("soft", 1): r"[A-Z=](\d+)S(?:\d+H)?$"}


def with_geometry(reads: DataFrame) -> DataFrame:
    """Adds end_pos, unclipped ends, and clips as sequenced.  A record that is all clip has it at the 5' end alone."""
    cigar, back = F.col("cigar"), F.col("flags").bitwiseAND(F.lit(0x10)) != 0
    only = F.regexp_like(cigar, F.lit(r"^\d+[A-Z=]$"))
    clip = {k: _length_of(cigar, p) for k, p in _CLIPS.items()}
    out = reads.withColumns({f"_{kind}_{side}": c for (kind, side), c in clip.items()} | {"end_pos": F.col("pos") + reference_length(cigar), "_turned": back & ~only})
    added = {}
    for kind in ("hard", "soft"):
        lead, trail = F.col(f"_{kind}_0"), F.col(f"_{kind}_1")
        added |= {f"{kind}_clip_5p": F.when(F.col("_turned"), trail).otherwise(lead), f"{kind}_clip_3p": F.when(F.col("_turned"), lead).otherwise(trail)}
    added["unclipped_start"] = F.col("pos") - F.col("_hard_0") - F.col("_soft_0")
    added["unclipped_end"] = F.col("end_pos") + F.col("_hard_1") + F.col("_soft_1")
    return out.withColumns(added).drop("_turned", *(f"_{kind}_{side}" for kind, side in clip))


def with_reference(reads: DataFrame, refs: DataFrame, flank: int, broadcast_bases: int = BROADCAST_BASES) -> DataFrame:
    """Adds refr, the reference from flank before pos to flank behind end_pos, ``_`` off the contig, and refr_start.

    refs: (contig, length, seq).  Small references are broadcast after a check of their
    size.  Larger ones are cut into tiles of several levels, as far as a contig needs them,
    and a read meets one tile, of the first level at which it lies on a single one; so
    reads are shuffled once, whatever they span.
    """
    reads = reads.withColumns({"refr_start": F.col("pos") - flank, "refr_stop": F.col("end_pos") + flank})
    bases = refs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if bases <= broadcast_bases:
        r = F.broadcast(refs.select(F.col("contig").alias("ref_name"), F.col("length").alias("ref_length"), F.col("seq").alias("ref_seq")))
        out = reads.join(r, "ref_name")
        return out.withColumn("refr", _cut(F.col("ref_seq"), F.lit(0), F.col("ref_length"), F.col("refr_start"), F.col("refr_stop"))).drop("ref_seq", "ref_length", "refr_stop")
    lengths = F.broadcast(refs.select(F.col("contig").alias("ref_name"), F.col("length").alias("ref_length")))
    known = reads.join(lengths, "ref_name").withColumns({"lo": F.greatest("refr_start", F.lit(0)), "hi": F.least("refr_stop", "ref_length")}).drop("ref_length")
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(F.col("hi") - F.floor(F.col("lo") / _tile(k)) * _tile(k) <= _tile(k) + _tile(k) // 4, k).otherwise(level)
    known = known.withColumn("level", level)
    known = known.withColumn("tile", F.floor(F.col("lo") / F.element_at(F.array(*(F.lit(_tile(k)) for k in range(LEVELS))), F.col("level") + 1)))
    tiles = refs.select("contig", "seq").mapInArrow(partial(_tiles, tile=TILE, larger=LARGER), "ref_name string, level int, tile bigint, tile_start bigint, part string")
    out = known.join(tiles, ["ref_name", "level", "tile"], "left")
    body = F.substr("part", (F.col("lo") - F.col("tile_start") + 1).cast("int"), F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).cast("int"))
    refr = F.concat(F.repeat(F.lit("_"), (F.col("lo") - F.col("refr_start")).cast("int")), F.coalesce(body, F.lit("")), F.repeat(F.lit("_"), (F.col("refr_stop") - F.greatest("hi", "lo")).cast("int")))
    return out.withColumn("refr", refr).drop("level", "tile", "tile_start", "part", "lo", "hi", "refr_stop")


def _tile(level: int) -> int:
    return TILE * LARGER**level


def _tiles(batches: Iterator[pa.RecordBatch], tile: int, larger: int = LARGER) -> Iterator[pa.RecordBatch]:
    """All tiles of contigs, by slices of their bytes; the last level of a contig is the first at which one tile shows all of it."""
    names = ["ref_name", "level", "tile", "tile_start", "part"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        *keys, parts = (pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True))
        return pa.RecordBatch.from_arrays([*keys, parts.cast(pa.string())], names=names)

    for batch in batches:
        offs, data = text_of(batch.column(1))
        held, size = [], 0
        for name, begin, end in zip(batch.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            for level in range(LEVELS):
                step = tile * larger**level
                for at in range(0, end - begin, step):
                    held.append((name, level, at // step, at, data[begin + at : min(begin + at + step + step // 4, end)].tobytes()))
                    size += len(held[-1][-1])
                    if size >= TILES_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
                if end - begin <= step + step // 4:
                    break
        if held:
            yield batch_of(held)


def _cut(seq: Column, offset: Column, length: Column, start: Column, stop: Column) -> Column:
    lo, hi = F.greatest(start, F.lit(0)), F.least(stop, length)
    body = F.substr(seq, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    before = F.repeat(F.lit("_"), F.least(lo - start, stop - start).cast("int"))
    return F.rpad(F.concat(before, body), (stop - start).cast("int"), F.lit("_")) if isinstance(stop, Column) else None


#: Stands for no offset.
NONE = np.iinfo(np.int64).min
#: What a walk needs of a record.
NEEDS = ("pos", "cigar", "seq", "quals", "refr", "refr_start", "walk_reversed")
_CODE = np.full(256, K.ANY, np.uint8)
for _letter in K.IUPAC[1:] + "U":
    _CODE[[ord(_letter), ord(_letter.lower())]] = K.code_of(_letter)
_REF_CODE = _CODE.copy()
_REF_CODE[ord("_")] = K.PAD
_COMPLEMENT = np.array([K.complement(c) for c in range(256)], np.uint8)
_CONSUMES = {op: (op in "MIS=X", op in "MDN=X") for op in "MIDNSHP=X"}
_READS, _REFERS = (np.array([chr(c) in _CONSUMES and _CONSUMES[chr(c)][k] for c in range(256)]) for k in (0, 1))
_LEFT, _RIGHT, _MATCH, _DELETED, _INTRON, _HOLE, _INSERTED, _SILENT = range(8)
_KIND = np.full(256, _SILENT, np.uint8)
for _ops, _kind in (("M=X", _MATCH), ("D", _DELETED), ("N", _INTRON), ("I", _INSERTED)):
    _KIND[[ord(x) for x in _ops]] = _kind


@dataclass(frozen=True)
class Steps:
    """How records are walked: columns beside the alignment, shown intron ends, and whether inserted bases show."""

    flank: int
    splice_context: int
    insertions: bool = False


@dataclass
class Columns:
    """Columns of the records of a batch; first cuts them, rec is the record of each."""

    first: np.ndarray
    rec: np.ndarray
    rd: np.ndarray
    rf: np.ndarray
    pos: np.ndarray
    off: np.ndarray
    #: Below 0 where there is none.
    q: np.ndarray


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts and end, bytes) of a string column; nulls count as empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offs - offs[0], np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]


def operations(cigar: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, operation, length) of all operations of a batch."""
    offs, data = text_of(cigar)
    at = np.flatnonzero(((data < 48) | (data > 57)) & (data != ord("*")))
    rec = np.searchsorted(offs, at, "right") - 1
    begin = np.maximum(np.concatenate([[0], at[:-1] + 1]) if len(at) else at, offs[rec])
    n, place = np.zeros(len(at), np.int64), 1
    for k in range(1, int((at - begin).max(initial=0)) + 1):
        n += np.where(at - k >= begin, data[np.maximum(at - k, 0)].astype(np.int64) - 48, 0) * place
        place *= 10
    return rec, data[at], n


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values.take(at, mode="clip") if len(values) else np.full(len(at), K.ANY, values.dtype)


def pieces(batch: pa.RecordBatch, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of whole records of about so many bases each."""
    offs = text_of(batch.column(batch.schema.get_field_index("seq")))[0] + 64 * np.arange(batch.num_rows + 1)
    cuts = np.unique(np.searchsorted(offs, np.arange(0, offs[-1] + size, size)).clip(0, batch.num_rows))
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(begin, end - begin)


def columns_of(batch: pa.RecordBatch, steps: Steps) -> Columns:
    """Walks all records of a batch that has the columns of NEEDS."""
    get = {k: batch.column(batch.schema.get_field_index(k)) for k in NEEDS}
    size_of = batch.num_rows
    pos, ref_start = (get[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "refr_start"))
    back = get["walk_reversed"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    seq_offs, seq = text_of(get["seq"])
    ref_offs, ref = text_of(get["refr"])
    size = np.diff(seq_offs)
    turned = np.flatnonzero(back)
    seq, ref = _CODE[seq], _REF_CODE[ref]
    if len(turned):
        for data, offs in ((seq, seq_offs), (ref, ref_offs)):
            here = np.repeat(back, np.diff(offs))
            np.copyto(data, _COMPLEMENT[data], where=here)
    quals, has_quals = get["quals"], get["quals"].is_valid().to_numpy(zero_copy_only=False)
    qual_offs = quals.offsets.to_numpy().astype(np.int64)
    values = quals.values.slice(qual_offs[0], qual_offs[-1] - qual_offs[0]) if size_of else quals.values
    qual_offs = qual_offs - qual_offs[0]
    qual = values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int16)

    # segments: the left flank, the operations, the right flank of each record
    rec, op, n = operations(get["cigar"])
    per = np.bincount(rec, minlength=size_of)
    cut = np.concatenate([[0], np.cumsum(per + 2)])
    where = np.arange(len(op)) + 2 * rec + 1
    total = int(cut[-1])
    owner, kind, length, q0, r0 = np.repeat(np.arange(size_of), per + 2), np.full(total, _SILENT, np.uint8), np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    op_first = np.concatenate([[0], np.cumsum(per)])
    reads, refers = np.where(_READS[op], n, 0), np.where(_REFERS[op], n, 0)
    read_sum, ref_sum = np.concatenate([[0], np.cumsum(reads)]), np.concatenate([[0], np.cumsum(refers)])
    q0[where] = read_sum[:-1] - read_sum[op_first[rec]]
    r0[where] = pos[rec] + ref_sum[:-1] - ref_sum[op_first[rec]]
    kind[where], length[where] = _KIND[op], n
    end = pos + ref_sum[op_first[1:]] - ref_sum[op_first[:-1]]
    left, right = cut[:-1], cut[1:] - 1
    kind[left], kind[right] = _LEFT, _RIGHT
    r0[left], r0[right] = pos - steps.flank, end
    length[left] = length[right] = steps.flank
    kind[(kind == _INTRON) & (length > 2 * steps.splice_context)] = _HOLE
    count = np.where(kind == _HOLE, 2 * steps.splice_context + 1, length)
    count[(kind == _SILENT) | ((kind == _INSERTED) & (not steps.insertions))] = 0

    # soft clips at the ends, behind hard ones
    clip = np.zeros((2, size_of), np.int64)
    soft, hard = op == ord("S"), op == ord("H")
    shown = per - np.bincount(rec[hard], minlength=size_of)
    for side, at, inward in ((0, op_first[:-1], 1), (1, op_first[1:] - 1, -1)):
        some = np.flatnonzero((shown > 1) if side else (shown > 0))
        at = at[some] + inward * hard[at[some]]
        clip[side, some] = np.where(soft[at], n[at], 0)
    q0[left], q0[right] = clip[0] - steps.flank, size - clip[1]

    # segments in the order of the walk; what a column shows is linear in its place in a segment, up or down
    if len(turned):
        order = np.arange(total)
        down = back[owner]
        order[down] = (cut[owner] + cut[owner + 1] - 1 - order)[down]
        kind, length, count, q0, r0 = (x[order] for x in (kind, length, count, q0, r0))
    rev = back[owner]
    begin = np.concatenate([[0], np.cumsum(count)])
    columns, step = int(begin[-1]), np.where(rev, -1, 1)
    flank, base = (kind == _LEFT) | (kind == _RIGHT), (kind == _MATCH) | (kind == _INSERTED)
    i = np.arange(columns) - np.repeat(begin[:-1], count)
    way = np.repeat(step, count)
    if len(turned):
        np.multiply(i, way, out=i)  # counted down where the walk goes back
    first = np.where(rev, count - 1, 0)
    r = np.repeat(r0 + first, count) + i
    at_read = np.repeat(q0 + first, count) + i
    rec_of = np.repeat(owner, count)

    # what most columns show; the fills of others take its place
    fill = np.full(total, K.SKIP, np.uint8)
    fill[kind == _DELETED], fill[flank] = K.GAP, K.PAD
    is_base = np.repeat(base, count)
    rd = np.where(is_base, _taken(seq, at_read + np.repeat(seq_offs[owner], count)), np.repeat(fill, count))
    passed = np.where(rev, size[owner] - 1 - q0, q0 - 1)  # the read base that the walk has passed last
    off = np.where(is_base, np.repeat(np.where(rev, size[owner] - 1, 0), count) + at_read * way, np.repeat(np.where(flank, NONE, passed), count))
    quality = np.full(columns, -1, np.int16)
    use = is_base if has_quals.all() else is_base & has_quals[rec_of]
    quality[use] = _taken(qual, (at_read + np.repeat(qual_offs[:-1][owner], count))[use])

    def of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, segment of each) of some segments."""
        which = np.flatnonzero(some & (count > 0))
        seg = np.repeat(which, count[which])
        return np.arange(len(seg)) - np.repeat(np.cumsum(count[which]) - count[which], count[which]) + begin[seg], seg

    # clipped bases beside the alignment
    at, seg = of(flank & (np.where(kind == _LEFT, clip[0, owner], clip[1, owner]) > 0))
    if len(at):
        here = at_read[at] - q0[seg]
        o = owner[seg]
        outer = np.where(kind[seg] == _LEFT, steps.flank - 1 - here, here)  # how far a flank's column is from the alignment
        clipped = outer < np.where(kind[seg] == _LEFT, clip[0, o], clip[1, o])
        at, o = at[clipped], o[clipped]
        rd[at] = K.CLIP
        off[at] = np.where(back[o], size[o] - 1 - at_read[at], at_read[at])
    # introns show their ends and a marker, inserted bases stand beside their neighbour
    at, seg = of(kind == _HOLE)
    context, marker = steps.splice_context, at[:0]
    if len(at):
        here, whole = r[at] - r0[seg], length[seg]
        r[at] = np.where(here > context, r0[seg] + whole - 2 * context - 1 + here, r[at])
        middle = here == context
        marker = at[middle]
        r[marker] = np.where(rev[seg], r0[seg] + whole - context - 1, r0[seg] + context)[middle]
    inserted, seg = of(kind == _INSERTED)
    r[inserted] = np.where(rev[seg], r0[seg], r0[seg] - 1)
    rf = _taken(ref, r + np.repeat((ref_offs[:-1] - ref_start)[owner], count))
    rf[marker], rf[inserted] = K.SKIP, K.GAP
    return Columns(begin[cut], rec_of, rd, rf, r, off, quality)


def beside(reads: DataFrame, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: str) -> DataFrame:
    """All columns of reads, and those that compute gives for a batch."""
    new = T._parse_datatype_string(added)
    kept = [f for f in reads.schema.fields if f.name not in new.fieldNames()]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*kept, *new.fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            got = compute(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *(got[f.name] for f in new.fields)], names=schema.fieldNames())

    return reads.mapInArrow(run, schema)


def walk(reads: DataFrame, flank: int, splice_context: int | None = None, insertions: bool = False) -> DataFrame:
    """Adds ``cols`` in walk order, an array of (rd, rf, pos, off, q).

    reads: pos, cigar, seq, quals (array, or null for none), refr, refr_start and
    walk_reversed.  insertions: show inserted bases; else they only advance the offset.
    """
    steps = Steps(flank, flank if splice_context is None else splice_context, insertions)

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        c = columns_of(batch, steps)
        parts = [pa.array(c.rd, pa.int32()), pa.array(c.rf, pa.int32()), pa.array(c.pos), pa.array(c.off, mask=c.off == NONE), pa.array(c.q, pa.int32(), mask=c.q < 0)]
        return {"cols": pa.ListArray.from_arrays(pa.array(c.first, pa.int32()), pa.StructArray.from_arrays(parts, ["rd", "rf", "pos", "off", "q"]))}

    return beside(reads, compute, f"cols array<{COLUMN}>")


#: All names that one byte can hold; a column shows no others.
_LETTER = np.frombuffer("".join(n if len(n := K.name_of(c)) == 1 else "*" for c in range(256)).encode(), np.uint8)
SPELLED = "record_id bigint, read string, refr string, positions bigint, offsets bigint, quals bigint"


def spelled(reads: DataFrame, steps: Steps) -> DataFrame:
    """For each record the columns of read and reference as text, in walk order, and sums of their positions, offsets and qualities.

    The sums take what isn't there as 0.  Columns stay in Python, so a record is one row of two texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            c = columns_of(batch, steps)
            texts = [pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(c.first.astype(np.int64)), pa.py_buffer(_LETTER[x])]).cast(pa.string()) for x in (c.rd, c.rf)]
            sums = [_summed(x, c.first) for x in (c.pos, np.where(c.off == NONE, 0, c.off), np.maximum(c.q, 0))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("record_id")), *texts, *map(pa.array, sums)], names=["record_id", "read", "refr", "positions", "offsets", "quals"])

    return reads.select("record_id", *NEEDS).mapInArrow(run, SPELLED)


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def chosen(reads: DataFrame, steps: Steps, wanted: Callable[[Columns], np.ndarray]) -> DataFrame:
    """(record_id, pos, off, rd, rf) of the columns that are wanted, by name; the others don't leave Python."""
    names = pa.array([K.name_of(c) for c in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            c = columns_of(batch, steps)
            at = np.flatnonzero(wanted(c))
            off = c.off[at]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("record_id")).take(pa.array(c.rec[at])), pa.array(c.pos[at]), pa.array(off, mask=off == NONE), names.take(pa.array(c.rd[at])), names.take(pa.array(c.rf[at]))], names=["record_id", "pos", "off", "rd", "rf"])

    return reads.select("record_id", *NEEDS).mapInArrow(run, "record_id bigint, pos bigint, off bigint, rd string, rf string")
