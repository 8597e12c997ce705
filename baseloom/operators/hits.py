"""Matching queries on walked records, and the hit rows that come of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baseloom.functions import codes as K
from baseloom.operators.boolean import Node
from baseloom.operators.patterns import Pattern, QueryFile
from baseloom.operators.walk import NEEDS, NONE, Columns, Steps, columns_of, pieces, text_of

#: Most reads differ from a right reference at a few in a hundred bases; conversion of C to T isn't a difference.
MAX_DISCORDANT, LEAST_COMPARED = 0.25, 1_000
#: What hit rows need of a record beside the walk.
CLIPS = ("mirrors_read", "hard_clip_5p", "hard_clip_3p")
_SINGLE = np.isin(np.arange(256), (1, 2, 4, 8))
_NAMES = pa.array([K.name_of(c) for c in range(256)])


class Matcher:
    """Tests of single columns, each made once for all patterns that have it."""

    def __init__(self, columns: Columns, span: int):
        self.size = len(columns.rd)
        pad = np.zeros(span, np.uint8)
        self.rd, self.rf = np.concatenate([columns.rd, pad]), np.concatenate([columns.rf, pad])
        self.known: dict[tuple, np.ndarray] = {}

    def _within(self, side: str, allowed: int) -> np.ndarray:
        if (side, allowed) not in self.known:
            self.known[side, allowed] = (getattr(self, side) & np.uint8(~allowed & K.ANY)) == 0
        return self.known[side, allowed]

    def _related(self, relation: str) -> np.ndarray:
        if relation not in self.known:
            equal = self.rd == self.rf
            self.known[relation] = _SINGLE[self.rd] & _SINGLE[self.rf] & (equal if relation == "same" else ~equal)
        return self.known[relation]

    def starts(self, pattern: Pattern) -> np.ndarray:
        """Whether the pattern matches from each column on, whatever record the next ones are of."""
        out = np.ones(self.size, bool)
        for j, c in enumerate(pattern):
            here = slice(j, j + self.size)
            if c.read != K.ANY:
                out &= self._within("rd", c.read)[here]
            if c.refr != K.ANY:
                out &= self._within("rf", c.refr)[here]
            if c.relation:
                out &= self._related(c.relation)[here]
        return out


def _true_at(node: Node, leaf, size: int) -> np.ndarray:
    if node.kind == "leaf":
        return leaf(node.value)
    if node.kind == "const":
        return np.full(size, bool(node.value))
    parts = [_true_at(p, leaf, size) for p in node.parts]
    if node.kind == "not":
        return ~parts[0]
    if node.kind == "count":
        total = np.sum(parts, axis=0)
        return (total >= node.low) & (total <= (len(parts) if node.high is None else node.high))
    return np.logical_and.reduce(parts) if node.kind == "and" else np.logical_or.reduce(parts)


def found_in(columns: Columns, queries: QueryFile) -> tuple[np.ndarray, np.ndarray]:
    """(start, query) of every hit, by record, then by the window's last column, then by query.

    A query holds on whole windows of its own span inside a record.
    """
    matcher, made = Matcher(columns, queries.max_span), {}
    room = columns.first[columns.rec + 1] - np.arange(len(columns.rec))  # columns from each one to its record's end

    def leaf(pattern: Pattern) -> np.ndarray:
        if pattern not in made:
            made[pattern] = matcher.starts(pattern)
        return made[pattern]

    starts, which, last = [], [], []
    for k, q in enumerate(queries.queries.values()):
        holds = _true_at(q.expression, lambda name, q=q: leaf(q.patterns[name]), matcher.size)
        at = np.flatnonzero(holds & (room >= q.span))
        starts.append(at)
        which.append(np.full(len(at), k))
        last.append(at + q.span - 1)
    starts, which, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, which, last))
    order = np.lexsort((which, last))
    return starts[order], which[order]


def as_sequenced_of(batch: pa.RecordBatch, rec: np.ndarray, off: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(distance from the read's 5' end, from its 3' end) of offsets of a batch's records, hard clips included; without SEQ the offset and null."""
    text = batch.column(batch.schema.get_field_index("seq"))
    some = (pc.fill_null(pc.not_equal(text, "*"), False).to_numpy(zero_copy_only=False) & (np.diff(text_of(text)[0]) > 0))[rec]
    five, three = _ends(batch, rec, off, some)
    return pa.array(np.where(some, five.fill_null(0).to_numpy(), off)), three


def _ends(batch: pa.RecordBatch, rec: np.ndarray, off: np.ndarray, shown: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """As ``as_sequenced``, of offsets of a batch's records; null where not shown."""
    mirrors, five_clip, three_clip = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in CLIPS)
    size = np.diff(text_of(batch.column(batch.schema.get_field_index("seq")))[0])[rec]
    five = np.where(mirrors[rec].astype(bool), size - 1 - off, off)
    shown = shown & (off != NONE)
    return pa.array(five + five_clip[rec].astype(np.int64), mask=~shown), pa.array(size - 1 - five + three_clip[rec].astype(np.int64), mask=~shown)


FLAT = "name string, read_5p bigint, read_3p bigint, refr_pos bigint, qual smallint, read_base string, refr_base string"
LISTS = "name string, read_5p bigint, read_3p bigint, refr_pos bigint, qual smallint, capture_col array<int>, capture_read array<string>, capture_refr array<string>, capture_qual array<smallint>, capture_read_5p array<bigint>, capture_read_3p array<bigint>, capture_refr_pos array<bigint>"


def _rows(batch: pa.RecordBatch, queries: QueryFile, steps: Steps) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(record of each hit, the hits' columns)."""
    c = columns_of(batch, steps)
    start, which = found_in(c, queries)
    specs = list(queries.queries.values())
    at = start + np.array([q.anchor for q in specs], np.int64)[which]
    rec = c.rec[at]
    five, three = _ends(batch, rec, c.off[at], c.rd[at] != K.PAD)
    out = {
        "name": pa.array([q.name for q in specs], pa.string()).take(pa.array(which)),
        "read_5p": five, "read_3p": three, "refr_pos": pa.array(c.pos[at]), "qual": pa.array(c.q[at], pa.int16(), mask=c.q[at] < 0),
    }
    if queries.flat:
        return rec, out | {"read_base": _NAMES.take(pa.array(c.rd[at])), "refr_base": _NAMES.take(pa.array(c.rf[at]))}
    many = np.array([len(q.captures) for q in specs])[which]
    cuts = np.concatenate([[0], np.cumsum(many)])
    hit = np.repeat(np.arange(len(which)), many)
    flat, begin = np.concatenate([q.captures for q in specs]), np.concatenate([[0], np.cumsum([len(q.captures) for q in specs])])
    col = flat[begin[which[hit]] + np.arange(len(hit)) - cuts[hit]].astype(np.int32)
    on = start[hit] + col
    shown = (c.rd[on] & np.uint8(K.GAP | K.SKIP | K.PAD)) == 0
    five, three = _ends(batch, c.rec[on], c.off[on], shown)
    lists = {
        "capture_col": pa.array(col), "capture_read": _NAMES.take(pa.array(c.rd[on])), "capture_refr": _NAMES.take(pa.array(c.rf[on])), "capture_qual": pa.array(c.q[on], pa.int16(), mask=c.q[on] < 0),
        "capture_read_5p": five, "capture_read_3p": three, "capture_refr_pos": pa.array(c.pos[on]),
    }
    return rec, out | {k: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), v) for k, v in lists.items()}


def hit_rows(reads: DataFrame, queries: QueryFile, steps: Steps, fields: list[str] = (), only_hits: bool = True) -> DataFrame:
    """A row for each hit: record_id, fields, name, read_5p, read_3p, refr_pos, qual, and what was captured.

    reads: called by a strand rule, with geometry and reference.  If all queries capture
    their anchor alone, read_base and refr_base; else parallel lists.  Without only_hits
    a record without a hit has one row of nulls.  Hits of a record come together, in order.
    """
    kept = list(dict.fromkeys(["record_id", *fields]))
    schema = T.StructType([T.StructField(k, reads.schema[k].dataType) for k in kept] + T._parse_datatype_string(FLAT if queries.flat else LISTS).fields)
    slim = reads.select(*dict.fromkeys([*kept, *NEEDS, *CLIPS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            rec, out = _rows(batch, queries, steps)
            if not only_hits:
                rest = np.setdiff1d(np.arange(batch.num_rows), rec)
                order = pa.array(np.argsort(np.concatenate([rec, rest]), kind="stable"))
                rec = np.sort(np.concatenate([rec, rest]))
                out = {k: pa.concat_arrays([v, pa.nulls(len(rest), v.type)]).take(order) for k, v in out.items()}
            if len(rec):
                at = pa.array(rec)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)).take(at) for k in kept), *out.values()], names=schema.fieldNames())

    return slim.mapInArrow(run, schema)


def concordance(reads: DataFrame, steps: Steps) -> DataFrame:
    """(compared, discordant): single bases on both sides, and those that differ by more than a conversion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            c = columns_of(batch, steps)
            both = _SINGLE[c.rd] & _SINGLE[c.rf]
            odd = both & (c.rd != c.rf) & ~((c.rf == K.C) & (c.rd == K.T))
            yield pa.RecordBatch.from_pydict({"n": [int(both.sum())], "d": [int(odd.sum())]})

    out = reads.select(*NEEDS).mapInArrow(run, "n bigint, d bigint")
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"), F.coalesce(F.sum("d"), F.lit(0)).alias("discordant"))


def assert_concordant(reads: DataFrame, steps: Steps, most: float = MAX_DISCORDANT, least: int = LEAST_COMPARED) -> None:
    compared, discordant = concordance(reads, steps).first()
    if compared >= least and discordant > most * compared:
        raise ValueError(f"{discordant} of {compared} bases differ from the reference: is it the one that the reads were aligned to?")


def steps_for(queries: QueryFile, flank: int | None = None, splice_context: int | None = None, insertions: bool = False) -> Steps:
    """Flank and shown intron ends are as wide as the widest query unless they are given."""
    span = queries.max_span
    return Steps(span if flank is None else flank, span if splice_context is None else splice_context, insertions)


def prepared(reads: DataFrame, refs: DataFrame, rule, steps: Steps, permissive: bool = False, md5s: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records to walk, with their reference; all records that the rule doesn't call unknown)."""
    from baseloom.operators.records import walkability
    from baseloom.operators.walk import with_geometry, with_reference

    called = rule.call(walkability(reads, refs, permissive, md5s)).filter("original <> 'unknown'")
    called = with_geometry(called)
    return with_reference(called.filter("status = 'walkable'"), refs, steps.flank), called


def scan(
    reads: DataFrame, refs: DataFrame, queries: QueryFile, rule, *, flank: int | None = None, splice_context: int | None = None,
    insertions: bool = False, fields: list[str] = (), only_hits: bool = True, permissive: bool = False, md5s: DataFrame | None = None,
) -> DataFrame:
    """Hit rows of aligned reads: strand calls, walk, matching, rows.

    Records that the rule calls unknown have no row at all; records that can't be
    walked have one of nulls, unless only hits are asked for.  md5s: (ref_name, m5) of
    the alignment's header, if every contig that a record lies on must have its checksum.
    """
    from baseloom.operators.records import with_fields

    steps = steps_for(queries, flank, splice_context, insertions)
    good, called = prepared(reads, refs, rule, steps, permissive, md5s)
    rows = hit_rows(with_fields(good, fields), queries, steps, [f.partition(":")[0] for f in fields], only_hits)
    if only_hits:
        return rows
    others = with_fields(called.filter("status <> 'walkable'"), fields).select("record_id", *(f.partition(":")[0] for f in fields))
    return rows.unionByName(others, allowMissingColumns=True)


#: What a scan counts.
COUNTERS = ("records", "unknown_strand", "unmapped", "off_reference", "missing_m5", "no_seq", "walkable")


def observed_scan(
    reads: DataFrame, refs: DataFrame, queries: QueryFile, rule, *, fields: list[str] = (), permissive: bool = False, md5s: DataFrame | None = None, **options
) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """Rows of hits, and a function that tells what the scan has counted once the rows have been used.

    The counts are taken while records pass, without a job of their own.
    """
    from baseloom.operators.records import walkability, with_fields
    from baseloom.operators.walk import with_geometry, with_reference

    steps = steps_for(queries, **options)
    seen, found = Observation(), Observation()
    called, known = rule.call(walkability(reads, refs, permissive, md5s)), F.col("original") != "unknown"
    counts = [F.count("*").alias("records"), F.count_if(~known).alias("unknown_strand"), *(F.count_if(known & (F.col("status") == k)).alias(k) for k in COUNTERS[2:])]
    good = with_geometry(called.observe(seen, *counts).filter(known & (F.col("status") == "walkable")))
    rows = hit_rows(with_fields(with_reference(good, refs, steps.flank), fields), queries, steps, [f.partition(":")[0] for f in fields])
    rows = rows.observe(found, F.count("*").alias("hits"), *(F.count_if(F.col("name") == q).alias(f"hits_{q}") for q in queries.queries))
    return rows, lambda: {**seen.get, **found.get}


def report_text(counts: dict[str, int]) -> str:
    """The counts, one on a line, those of records first."""
    return "\n".join(f"{k.replace('_', ' ')}\t{v}" for k, v in counts.items())
