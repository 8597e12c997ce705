"""Tags of one character for each base, written from hits and read back into hits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baseloom.functions import codes as K
from baseloom.operators.hits import CLIPS, FLAT, as_sequenced_of, found_in
from baseloom.operators.patterns import QueryError, QueryFile
from baseloom.operators.walk import Columns, Steps, beside, columns_of, operations, pieces, text_of

ORIGINS = ("OT", "CTOT", "OB", "CTOB")


@dataclass(frozen=True)
class BasesTag:
    name: str
    fill: str
    #: Query by code.
    codes: dict[str, str]


@dataclass(frozen=True)
class StrandTag:
    name: str
    #: Value by strand of origin.
    values: dict[str, str]


def _name(name: str) -> str:
    if len(name) != 2 or not name[0].isalpha() or not name.isalnum() or not name.isascii():
        raise QueryError(f"{name!r} isn't a tag's name")
    return name


def bases_tag(name: str, table: dict, queries) -> BasesTag:
    fill = table.get("fill")
    codes = {k: v for k, v in table.items() if k != "fill"}
    one = lambda c: isinstance(c, str) and len(c) == 1 and "!" <= c <= "~"
    if not one(fill):
        raise QueryError(f"tag {name}: fill is one printable character")
    for code, query in codes.items():
        if not one(code) or not isinstance(query, str) or query not in queries:
            raise QueryError(f"tag {name}: a code is one printable character and stands for one query, not {code!r} = {query!r}")
    if not codes or fill in codes or len(set(codes.values())) < len(codes):
        raise QueryError(f"tag {name}: codes differ from the fill, and each query has one")
    return BasesTag(_name(name), fill, codes)


def strand_tag(name: str, table: dict) -> StrandTag:
    values = {}
    for value, origins in table.items():
        for o in [origins] if isinstance(origins, str) else origins:
            if o not in ORIGINS or o in values:
                raise QueryError(f"tag {name}: {o!r} isn't a strand of origin, or comes twice")
            values[o] = value
    if set(values) != set(ORIGINS):
        raise QueryError(f"tag {name}: all of {', '.join(ORIGINS)} have a value")
    return StrandTag(_name(name), values)


def declared(queries: QueryFile) -> list[BasesTag | StrandTag]:
    out = []
    for name, table in queries.tags.items():
        for kind, content in table.items():
            if kind not in ("bases", "strand"):
                raise QueryError(f"tag {name}: no kind {kind!r}")
            out.append(bases_tag(name, content, queries.queries) if kind == "bases" else strand_tag(name, content))
    return out


def _text(tag: BasesTag, batch: pa.RecordBatch, columns: Columns, start: np.ndarray, which: np.ndarray, specs: list) -> tuple[pa.Array, np.ndarray]:
    """(the tag of each record of a batch, hits of each without a base to stand on)."""
    code_of = {q: ord(c) for c, q in tag.codes.items()}
    code = np.array([code_of.get(q.name, 0) for q in specs], np.uint8)[which]
    at = (start + np.array([q.anchor for q in specs], np.int64)[which])[code > 0]
    code, rec = code[code > 0], columns.rec[at]
    names = batch.column(batch.schema.get_field_index("qname"))
    on_gap = np.flatnonzero(columns.rd[at] & np.uint8(K.GAP | K.SKIP))
    if len(on_gap):
        raise ValueError(f"tag {tag.name}: an anchor on a gap or skip of read {names[int(rec[on_gap[0]])]}")
    offs, _ = text_of(batch.column(batch.schema.get_field_index("seq")))
    back = batch.column(batch.schema.get_field_index("walk_reversed")).to_numpy(zero_copy_only=False).astype(bool)
    size, off = np.diff(offs)[rec], columns.off[at]
    good = ((columns.rd[at] & np.uint8(K.PAD | K.CLIP)) == 0) & (off >= 0) & (off < size)
    place = (offs[rec] + np.where(back[rec], size - 1 - off, off))[good]
    out = np.full(offs[-1], ord(tag.fill), np.uint8)
    out[place] = code[good]
    clash = np.flatnonzero(out[place] != code[good])
    if len(clash):
        raise ValueError(f"tag {tag.name}: two codes at one base of read {names[int(rec[good][clash[0]])]}")
    text = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(offs), pa.py_buffer(out)]).cast(pa.string())
    return text, np.bincount(rec[~good], minlength=batch.num_rows)


def _named_otherwise(name: str):
    return lambda k, _: k != name


def with_tags(reads: DataFrame, queries: QueryFile, steps: Steps, overwrite: bool = False) -> DataFrame:
    """Adds declared tags to ``tags`` of records, and the number of hits without a base as ``unplaced``.

    reads: called by a strand rule, with geometry and reference.  Two codes at one base
    are an error, as is an anchor on a gap or skip, and a tag that the record has already
    unless overwriting.
    """
    specs, found = list(queries.queries.values()), declared(queries)
    of_bases = [t for t in found if isinstance(t, BasesTag)]

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        columns = columns_of(batch, steps)
        start, which = found_in(columns, queries)
        out, unplaced = {}, np.zeros(batch.num_rows, np.int64)
        for tag in of_bases:
            out[f"_tag_{tag.name}"], lost = _text(tag, batch, columns, start, which, specs)
            unplaced += lost
        return out | {"unplaced": pa.array(unplaced, pa.int32())}

    out = beside(reads, compute, ", ".join([*(f"`_tag_{t.name}` string" for t in of_bases), "unplaced int"]))
    for tag in found:
        if isinstance(tag, StrandTag):
            value = F.create_map(*(F.lit(x) for kv in tag.values.items() for x in kv))[F.col("conv_strand")]
        else:
            value = F.col(f"_tag_{tag.name}")
        entry = F.create_map(F.lit(tag.name), F.struct(F.lit("Z").alias("type"), value.alias("value")))
        rest = F.map_filter("tags", _named_otherwise(tag.name))
        if not overwrite:
            there = F.raise_error(F.concat(F.lit(f"tag {tag.name} is there already in read "), F.col("qname")))
            rest = F.when(F.map_contains_key("tags", tag.name), there.cast(out.schema["tags"].dataType)).otherwise(rest)
        out = out.withColumn("tags", F.map_concat(rest, entry))
    return out.drop(*(f"_tag_{t.name}" for t in of_bases))


def choose(tags: list[BasesTag | StrandTag], wanted: str | None = None) -> BasesTag:
    bases = [t for t in tags if isinstance(t, BasesTag)]
    picked = [t for t in bases if wanted in (None, t.name)]
    if len(picked) != 1:
        raise QueryError(f"which tag of {', '.join(t.name for t in bases) or 'none'}?")
    return picked[0]


def extract(reads: DataFrame, queries: QueryFile, tag: str | None = None, fields: list[str] = ()) -> DataFrame:
    """Hit rows read back from a bases tag: the same as from a scan with flat captures.

    reads: called by a strand rule, with geometry.  The reference base is the one that
    the query's anchor must stand on, else null.
    """
    spec = choose(declared(queries), tag)
    value = F.try_element_at("tags", F.lit(spec.name))
    text = value["value"]
    wrong = F.when(value.isNull(), F.lit(None)).when(value["type"] != "Z", F.raise_error(F.lit(f"tag {spec.name} isn't text")).cast("string")).when(F.length(text) != F.length("seq"), F.raise_error(F.concat(F.lit(f"tag {spec.name} and SEQ differ in length in read "), F.col("qname"))).cast("string")).otherwise(text)
    kept = list(dict.fromkeys(["record_id", *fields]))
    slim = reads.withColumn("_text", F.when(F.col("original") == "unknown", F.lit(None)).otherwise(wrong)).select(*dict.fromkeys([*kept, "pos", "cigar", "seq", "quals", "walk_reversed", *CLIPS]), "_text")
    schema = T.StructType([reads.schema[k] for k in kept] + T._parse_datatype_string(FLAT).fields)
    names = schema.fieldNames()
    code_known = np.zeros(256, bool)
    code_known[[ord(c) for c in (*spec.codes, spec.fill)]] = True
    which = np.zeros(256, np.int64)
    which[[ord(c) for c in spec.codes]] = np.arange(len(spec.codes))
    called, stands_on = list(spec.codes.values()), [queries.queries[q].anchor_refr for q in spec.codes.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            get = lambda k: batch.column(batch.schema.get_field_index(k))
            offs, codes = text_of(get("_text"))
            odd = codes[~code_known[codes]]
            if len(odd):
                raise ValueError(f"tag {spec.name}: no code {chr(odd[0])}")
            at = np.flatnonzero(codes != ord(spec.fill))
            rec = np.searchsorted(offs, at, "right") - 1
            s, code = at - offs[rec], codes[at]
            seq_offs, seq = text_of(get("seq"))
            back = get("walk_reversed").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)[rec]
            five, three = as_sequenced_of(batch, rec, np.where(back, np.diff(seq_offs)[rec] - 1 - s, s))
            place, placed = places_of(batch, rec, s)
            base = seq[seq_offs[rec] + s]
            quals = get("quals")
            begin, values = quals.offsets.to_numpy().astype(np.int64), quals.values.to_numpy(zero_copy_only=False)
            rated = s < np.diff(begin)[rec]
            rated &= quals.is_valid().to_numpy(zero_copy_only=False)[rec]
            qual = np.full(len(s), np.nan)
            qual[rated] = values[begin[rec[rated]] + s[rated]]
            query = pa.array(which[code])
            out = [
                pa.array(called, pa.string()).take(query), five, three, pa.array(place, mask=~placed), pa.array(np.nan_to_num(qual).astype(np.int16), mask=np.isnan(qual)),
                _LETTERS.take(pa.array(np.where(back, _TURNED[base], base))), pa.array(stands_on, pa.string()).take(query),
            ]
            yield pa.RecordBatch.from_arrays([*(get(k).take(pa.array(rec)) for k in kept), *out], names=names)

    return slim.mapInArrow(run, schema)


#: Bytes as text, and those of bases by their complements.
_LETTERS = pa.array([chr(c) if c < 128 else "?" for c in range(256)])
_TURNED = np.arange(256, dtype=np.uint8)
_TURNED[[ord(c) for c in "ACGT"]] = [ord(c) for c in "TGCA"]


def places_of(batch: pa.RecordBatch, rec: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(reference position, whether the CIGAR has the base) of places in SEQ; inserted and clipped bases have the one nearest on the 5' side of the walk."""
    get = lambda k: batch.column(batch.schema.get_field_index(k))
    pos, back = get("pos").to_numpy(zero_copy_only=False).astype(np.int64), get("walk_reversed").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    owner, op, n = operations(get("cigar"))
    is_in = lambda kinds: np.isin(op, [ord(k) for k in kinds])
    per = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
    before = {}
    for kinds in ("M=XIS", "MDN=X"):
        total = np.concatenate([[0], np.cumsum(np.where(is_in(kinds), n, 0))])
        before[kinds] = total, total[:-1] - total[per[owner]]
    total, _ = before["M=XIS"]
    r = pos[owner] + before["MDN=X"][1]
    placed = s < (total[per[1:]] - total[per[:-1]])[rec]
    # operations lie one behind the other on the bases of all records; the one of a base is the last that starts at or before it
    at = np.searchsorted(total, total[per[rec]] + s, "right") - 1
    at = np.minimum(at, max(0, len(op) - 1))
    if not len(op):
        return np.zeros(len(s), np.int64), np.zeros(len(s), bool)
    inside = total[per[rec]] + s - total[at]
    beside = np.where(back[rec], r[at], r[at] - 1)
    return np.where(is_in("M=X")[at], r[at] + inside, beside), placed
