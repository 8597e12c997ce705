"""Columns of an alignment record, and which records can be walked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.operators.strand import FLAGS

_TEXT = {"qname": "qname", "ref_name": "ref_name", "cigar": "cigar", "mate_ref_name": "mate_ref_name", "seq_ascii": "seq", "qual_phred": "qual", "strand": "strand", "conv_strand": "conv_strand"}
_WHOLE = {
    "flags": "int", "mapq": "smallint", "tid": "int", "mate_tid": "int", "pos": "bigint", "end_pos": "bigint", "unclipped_start": "bigint", "unclipped_end": "bigint", "read_len": "bigint",
    "hard_clip_5p": "bigint", "hard_clip_3p": "bigint", "soft_clip_5p": "bigint", "soft_clip_3p": "bigint", "insert_size": "bigint", "mate_pos": "bigint",
}
FIELDS = (*_TEXT, *_WHOLE, *FLAGS, "read_reverse")
GROUPS = {
    "core": ["ref_name", "strand"],
    "all": list(FIELDS),
    "bools": [*FLAGS, "read_reverse"],
    "mate": ["mate_tid", "mate_ref_name", "mate_pos", "insert_size"],
    "coords": ["ref_name", "pos", "end_pos", "unclipped_start", "unclipped_end"],
}
#: Other names of fields.
ALIASES = {"rname": "ref_name", "chrom": "ref_name", "tlen": "insert_size", "seq": "seq_ascii", "qual": "qual_phred", "flag": "flags", "rnext": "mate_ref_name", "pnext": "mate_pos", "is_read1": "is_first_in_template", "is_read2": "is_last_in_template"}


def expand(names: list[str], start: list[str] | None = None) -> list[str]:
    """Fields by name, group, alias or TAG:type; a column named twice comes once, where it was first."""
    out: dict[str, str] = {}
    for n in [*(start or []), *names]:
        for field in GROUPS.get(n, [ALIASES.get(n, n)]):
            column = field.partition(":")[0]
            if ":" not in field and field not in FIELDS:
                raise KeyError(f"no field named {n!r}")
            out.setdefault(column, field)
    return list(out.values())


def tag_value(tags: Column, tag: str, kind: str) -> Column:
    """A tag as i, f, or text; whole numbers widen to floats, other mismatches are null."""
    got = F.try_element_at(tags, F.lit(tag))
    if kind in "icCsSI":
        return F.when(got["type"].isin(*"icCsSI"), got["value"].try_cast("bigint"))
    if kind in "fd":
        return F.when(got["type"].isin(*"icCsSIfd"), got["value"].try_cast("double"))
    return F.when(got["type"].isin(*"ZAHB"), got["value"])


def with_fields(reads: DataFrame, fields: list[str]) -> DataFrame:
    """Adds the record fields, among them ``TAG:type``, as columns named without the type."""
    have, added = set(reads.columns), {}
    for field in fields:
        name, _, kind = field.partition(":")
        if kind:
            added[name] = tag_value(F.col("tags"), name, kind)
        elif name in FLAGS:
            added[name] = F.col("flags").bitwiseAND(F.lit(FLAGS[name])) != 0
        elif name == "read_reverse":
            added[name] = F.col("aligned") == "reverse"
        elif name == "read_len":
            added[name] = F.when(F.col("seq") == "*", F.lit(0)).otherwise(F.length("seq")).cast("bigint")
        elif name in ("tid", "mate_tid"):
            source = F.col(name) if name in have else F.lit(None)
            added[name] = F.when(source >= 0, source).cast("int")
        elif name in _WHOLE:
            added[name] = (F.col(name) if name in have else F.lit(None)).cast(_WHOLE[name])
        elif name in _TEXT:
            added[name] = (F.col(_TEXT[name]) if _TEXT[name] in have else F.lit(None)).cast("string")
        else:
            raise KeyError(f"no field named {field!r}")
    return reads.withColumns(added) if added else reads


def walkability(reads: DataFrame, refs: DataFrame, permissive: bool = False, md5s: DataFrame | None = None) -> DataFrame:
    """Adds status: unmapped, off_reference, missing_m5, no_seq or walkable, the first that fits.

    A record off the reference stops the run unless permissive, and so does one on a
    contig without its checksum.  md5s: (ref_name, m5) of the alignment's header, if
    every contig must have one.
    """
    known = F.broadcast(refs.select(F.col("contig").alias("ref_name"), F.lit(True).alias("_on")))
    out = reads.join(known, "ref_name", "left")
    m5 = F.lit(True)
    if md5s is not None:
        out = out.join(F.broadcast(md5s.select("ref_name", F.col("m5").isNotNull().alias("_m5"))), "ref_name", "left")
        m5 = F.coalesce("_m5", F.lit(False))

    def or_stop(status: str, why: str) -> Column:
        return F.lit(status) if permissive else F.raise_error(F.concat(F.lit(why), F.coalesce("ref_name", F.lit("*")))).cast("string")

    lost, unchecked = or_stop("off_reference", "contig isn't in the reference: "), or_stop("missing_m5", "no checksum in the header for contig ")
    status = F.when(F.col("flags").bitwiseAND(F.lit(4)) != 0, "unmapped").when(F.col("_on").isNull(), lost).when(~m5, unchecked).when(F.col("seq") == "*", "no_seq").otherwise("walkable")
    return out.withColumn("status", status).drop("_on", "_m5")
