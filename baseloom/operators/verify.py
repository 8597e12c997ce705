"""Do hits stand where they say: contigs and bases of hit tables against a reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFTS = (0, -1, 1, -2, 2)
PASS = 0.99


def contig_check(hits: DataFrame, refs: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(contig, status) for contigs of either: ok, absent (from the reference), wrong_length or unused.

    lengths: (contig, length) as the hits' own header has them.
    """
    used = hits.select(F.col("contig").alias("c")).distinct()
    if lengths is not None:
        used = used.join(lengths.select(F.col("contig").alias("c"), F.col("length").alias("own")), "c", "full")
    else:
        used = used.withColumn("own", F.lit(None).cast("bigint"))
    both = used.join(refs.select(F.col("contig").alias("r"), "length"), F.col("c") == F.col("r"), "full")
    status = F.when(F.col("r").isNull(), "absent").when(F.col("c").isNull(), "unused").when(F.col("own") != F.col("length"), "wrong_length").otherwise("ok")
    return both.select(F.coalesce("c", "r").alias("contig"), status.alias("status"))


def sampled(hits: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n hits, the same at each run: those with the least seeded hash."""
    return hits.orderBy(F.xxhash64(*hits.columns, F.lit(seed)), *(c for c in ("contig", "refr_pos") if c in hits.columns)).limit(n)


#: Bases of a tile that hits are looked up in; small, because a base is found by counting from the tile's start.
LOOKUP = 256


def shift_check(hits: DataFrame, refs: DataFrame, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """(shift, checked, matched): does the reference base stand at refr_pos + shift.

    Hits on the minus strand show the complement; without a strand column either
    orientation will do.  A hit meets its tile of the reference, which reaches as far as
    the shifts on either side, once; so no reference is broadcast.
    """
    if "strand" not in hits.columns and "conv_strand" in hits.columns:
        hits = hits.withColumn("strand", F.when(F.col("conv_strand").isin("OB", "CTOB"), "-").otherwise("+"))
    reach, base = max(map(abs, shifts)), F.upper("refr_base")
    asked = hits.filter(base.isin("A", "C", "G", "T")).select("contig", F.col("refr_pos").alias("p"), base.alias("b"), *(["strand"] if "strand" in hits.columns else []))
    asked = asked.withColumn("tile", F.floor(F.col("p") / LOOKUP))
    tile = F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / LOOKUP))
    padded = F.concat(F.repeat(F.lit("_"), F.lit(reach)), F.col("seq"), F.repeat(F.lit("_"), F.lit(reach)))
    tiles = refs.withColumn("seq", padded).withColumn("tile", F.explode(tile)).select("contig", "tile", F.substr("seq", (F.col("tile") * LOOKUP + 1).cast("int"), F.lit(LOOKUP + 2 * reach)).alias("part"))
    joined = asked.join(tiles, ["contig", "tile"], "left").withColumn("at", (F.col("p") - F.col("tile") * LOOKUP + reach + 1).cast("int"))
    turned = F.translate("b", "ACGT", "TGCA")

    def matches(shift: int) -> Column:
        there = F.upper(F.substr("part", F.col("at") + shift, F.lit(1)))
        wanted = (there == F.when(F.col("strand") == "-", turned).otherwise(F.col("b"))) if "strand" in hits.columns else (there == F.col("b")) | (there == turned)
        return F.count_if(F.coalesce(wanted, F.lit(False)))

    counts = joined.agg(F.count("*").alias("checked"), *(matches(s).alias(f"m{k}") for k, s in enumerate(shifts)))
    rows = F.array(*(F.struct(F.lit(s).alias("shift"), F.col("checked"), F.col(f"m{k}").alias("matched")) for k, s in enumerate(shifts)))
    return counts.select(F.inline(rows)).filter("checked > 0")


def placed_bases(hits: DataFrame) -> DataFrame:
    """Hits with one refr_base and refr_pos a row: lists of captures become a row for each captured column."""
    if "capture_refr" not in hits.columns:
        return hits
    pairs = F.arrays_zip(F.col("capture_refr").alias("b"), F.col("capture_refr_pos").alias("p"))
    flat = hits.drop("refr_base", "refr_pos").withColumn("_at", F.explode(pairs))
    return flat.withColumns({"refr_base": F.col("_at")["b"], "refr_pos": F.col("_at")["p"]}).drop("_at")


@dataclass
class Report:
    passed: bool
    text: str
    #: Reference bases that were looked up.
    checked: int = 0


def check(hits: DataFrame, refs: DataFrame, lengths: DataFrame | None = None, strict: bool = True, sample: int | None = None, seed: int = 0) -> Report:
    """Both checks; strict: raises what it finds wrong.

    sample: look up so many bases only, the same at each run; contigs are all checked.
    """
    contigs = {r.contig: r.status for r in contig_check(hits, refs, lengths).collect()}
    wrong = [f"{c}: {s}" for c, s in sorted(contigs.items()) if s in ("absent", "wrong_length")]
    fatal = any(s == "wrong_length" for s in contigs.values()) or not any(s == "ok" for s in contigs.values())
    bases = placed_bases(hits)
    if sample is not None:
        bases = sampled(bases, sample, seed)
    shifts = {r.shift: (r.checked, r.matched) for r in shift_check(bases, refs).collect()}
    checked, matched = shifts.get(0, (0, 0))
    good = checked > 0 and matched >= PASS * checked
    best = max(shifts, key=lambda k: shifts[k][1] / max(shifts[k][0], 1), default=0)
    text = "\n".join([*wrong, f"{matched} of {checked} reference bases are where the hits say", *([f"best at a shift of {best}: {shifts[best][1]} of {shifts[best][0]}"] if not good and shifts else [])])
    report = Report(good and not fatal, text, checked)
    if strict and not report.passed:
        raise ValueError(report.text)
    return report
