"""Mates of a fragment that observed the same bases: find the overlap, agree, and count it once.

Where both mates align a reference position, on opposite strands, each such position
implies a fragment length: the bases from either mate's own 5' end, and the shared one.
The length whose positions reach furthest to both ends is chosen if it stands up to the
checks; base i of one mate then is base length - 1 - i of the other.  Qualities are
merged, and the overlap is clipped from the mate with less evidence.

Fragments come together by one shuffle on qname.  A task works on thousands of them at
once: their bases are one set of NumPy arrays, which is joined with itself on the
reference position and grouped by fragment and implied length.  Python loops see only
records that change, and only to write their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from baseloom.functions import codes as K
from baseloom.operators.walk import Columns, Steps, columns_of, operations, text_of

CHOICES = {
    "on_unresolved": ("pass", "drop"),
    "mismatch_qual": ("subtract", "none", "zero_both", "zero_loser"),
    "mismatch_base": ("none", "set_n"),
    "match_qual": ("sum_capped", "none", "max"),
    "keep": ("score", "r1", "r2"),
}
#: Refusals in the order in which they are tried; the last one takes the place of two others.
REASONS = ("low_support", "past_end", "anchor_slack", "short_span", "high_mismatch", "ambiguous_l", "indel_disagreement")
SINGLE, NO_OVERLAP, UNRESOLVED, RESOLVED = VERDICTS = ("single", "none", "unresolved", "resolved")
#: FLAG bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, LAST, SECONDARY, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x80, 0x100, 0x800
COUNTS = (
    "positions_compared", "positions_match", "positions_mismatch", "positions_unpaired", "positions_ambiguous", "quals_raised", "quals_lowered",
    "bases_set_n", "bases_clipped", "bases_hard_clipped", "records_dropped",
)
#: Bytes of records that a task works on at once, in whole fragments, so that their arrays stay near a core; and records that are looked at together.
CHUNK, SLICE = 2 << 20, 16


@dataclass(frozen=True)
class Options:
    length_tolerance: int = 0
    min_overlap: int = 4
    min_support: int = 3
    min_span_frac: float = 0.7
    max_anchor_slack: int = 5
    max_past_end: int = 0
    max_mismatch_frac: float = 0.15
    ambiguity_ratio: float = 0.8
    indel_window: int = 10
    on_unresolved: str = "pass"
    mismatch_qual: str = "subtract"
    mismatch_base: str = "none"
    match_qual: str = "sum_capped"
    qual_cap: int = 40
    keep: str = "score"
    score_qual_weight: float = 1.0
    hard_clip: bool = False
    clean_kept_3prime: bool = True
    terminal_indel_window: int = 3
    tag_prefix: str = "o"

    def __post_init__(self):
        for name, known in CHOICES.items():
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}")


def with_options(**changes) -> Options:
    return replace(Options(), **changes)


def _cut(owner: np.ndarray, count: int) -> np.ndarray:
    """Where the entries of each owner start, owners being sorted, and the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))])


def _inside(values: np.ndarray, cut: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums of values before each entry, of the same owner."""
    total = np.concatenate([[0], np.cumsum(values)])[:-1]
    begin = np.minimum(cut[:-1], max(0, len(total) - 1))
    return total - (total[begin] if len(total) else total)[owner]


def _span_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place in it) of all entries, if each owner has so many."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _mean(values: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Means by owner; nan without values."""
    n = np.bincount(owner, minlength=count)
    return np.where(n > 0, np.bincount(owner, values, count) / np.maximum(n, 1), np.nan)


class Fragments:
    """Records of whole fragments, their operations and bases, as arrays."""

    def __init__(self, table: pa.Table):
        self.table = table
        get = lambda k: table.column(k).combine_chunks()
        number = lambda k, null=0: get(k).fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = table.num_rows
        self.flags, self.mapq, self.tid, self.pos = number("flags"), number("mapq"), number("tid", -1), number("pos")
        names = get("qname").dictionary_encode()
        self.frag = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.qnames, self.count = names.dictionary, len(names.dictionary)
        self.last, self.reverse, self.extra = (self.flags & LAST > 0).astype(np.int64), self.flags & REVERSE > 0, self.flags & SUPPLEMENTARY > 0
        cigar = get("cigar").fill_null("*")
        self.rec, self.op, self.n = operations(cigar)
        self.cut = _cut(self.rec, self.size)
        has = lambda kinds: np.isin(self.op, [ord(k) for k in kinds])
        self.aligned_op, self.query_op, self.refers, self.hard = has("M=XI"), has("MIS=X"), has("MDN=X"), has("H")
        self.takes_part = (self.flags & (SECONDARY | UNMAPPED) == 0) & (np.diff(self.cut) > 0)
        self.read_length = np.bincount(self.rec, np.where(self.query_op | self.hard, self.n, 0), self.size).astype(np.int64)
        self.query_length = np.bincount(self.rec, np.where(self.query_op, self.n, 0), self.size).astype(np.int64)
        head = self.cut[:-1][np.diff(self.cut) > 0]
        self.hard_lead = np.zeros(self.size, np.int64)
        self.hard_lead[self.rec[head]] = np.where(self.hard[head], self.n[head], 0)
        #: Aligned bases, and reference bases, before each operation.
        self.aligned_before = _inside(np.where(self.aligned_op, self.n, 0), self.cut, self.rec)
        self.refer_before = _inside(np.where(self.refers, self.n, 0), self.cut, self.rec)
        self.aligned_length = np.bincount(self.rec, np.where(self.aligned_op, self.n, 0), self.size).astype(np.int64)
        self.seq_offs, seq = text_of(get("seq"))
        self.seq = seq.copy()
        quals = get("quals")
        self.has_quals = quals.is_valid().to_numpy(zero_copy_only=False) if self.size else np.zeros(0, bool)
        at, flat = quals.offsets.to_numpy().astype(np.int64), quals.values.to_numpy(zero_copy_only=False)
        self.qual = np.full(len(self.seq), -1, np.int64)
        owner, place = _span_of(np.diff(self.seq_offs) * self.has_quals)
        self.qual[self.seq_offs[owner] + place] = flat[at[owner] + place]
        # a record without its sequence can't be compared
        self.takes_part &= np.diff(self.seq_offs) == self.query_length
        self._bases()

    def _bases(self) -> None:
        """All bases of records that take part: record, place in SEQ, whether aligned, reference position (-1: none), and bases from the read's 5' end."""
        use = np.flatnonzero(self.query_op & self.takes_part[self.rec])
        query_before = _inside(np.where(self.query_op, self.n, 0), self.cut, self.rec)[use]
        which, i = _span_of(self.n[use])
        op = use[which]
        self.b_rec, self.b_at = self.rec[op], query_before[which] + i
        self.b_aligned = self.aligned_op[op]
        self.b_place = np.where(self.refers[op], self.pos[self.b_rec] + self.refer_before[op] + i, -1)
        forward = self.b_at + self.hard_lead[self.b_rec]
        self.b_end = np.where(self.reverse[self.b_rec], self.read_length[self.b_rec] - 1 - forward, forward)


@dataclass
class Decisions:
    """What is decided for each fragment, and for each record."""

    verdict: np.ndarray
    reason: np.ndarray
    length: np.ndarray
    overlap: np.ndarray
    support: np.ndarray
    span_frac: np.ndarray
    first_kept: np.ndarray
    counts: dict[str, np.ndarray]
    #: Aligned bases that are clipped from SEQ's start and end.
    front: np.ndarray
    back: np.ndarray
    drop: np.ndarray
    promote: np.ndarray
    edited: np.ndarray


class Resolver:
    """Decides on all fragments of a chunk; new qualities and bases are written into the fragments' arrays."""

    def __init__(self, f: Fragments, options: Options):
        self.f, self.o = f, options
        none = lambda kind=np.int64: np.zeros(f.count, kind)
        self.old_qual = f.qual.copy()
        self.d = Decisions(
            none(), np.full(f.count, -1), np.full(f.count, -1), none(), none(), none(float), np.full(f.count, -1), {k: none() for k in COUNTS},
            np.zeros(f.size, np.int64), np.zeros(f.size, np.int64), np.zeros(f.size, bool), np.zeros(f.size, bool), np.zeros(f.size, np.int64),
        )

    def run(self) -> Decisions:
        self._ends()
        self._implied_lengths()
        if len(self.t_frag):
            self._choose()
            self._compare()
            self._judge()
            self._merge_evidence()
            self._keep_one()
        self._finish()
        return self.d

    def _ends(self) -> None:
        """The two reads of each fragment: their lengths, the best record for each base, and the last aligned base."""
        f, d = self.f, self.d
        side = 2 * f.frag + f.last
        use = np.flatnonzero(f.takes_part)
        self.read_len, least = np.zeros(2 * f.count, np.int64), np.full(2 * f.count, 1 << 62)
        np.maximum.at(self.read_len, side[use], f.read_length[use])
        np.minimum.at(least, side[use], f.read_length[use])
        both = (self.read_len.reshape(-1, 2) > 0).all(1)
        d.verdict[both] = VERDICTS.index(NO_OVERLAP)
        uneven = (self.read_len > 0) & (self.read_len - least > self.o.length_tolerance)
        self.open = both & ~uneven.reshape(-1, 2).any(1)
        d.verdict[both & ~self.open] = VERDICTS.index(UNRESOLVED)
        own = side[f.b_rec]
        fits = np.flatnonzero((f.b_end >= 0) & (f.b_end < self.read_len[own]) & self.open[f.frag[f.b_rec]])
        key = (own[fits] << 32) | f.b_end[fits]
        order = np.argsort(key, kind="stable")  # runs, up or down, of records
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        if not first.all():  # several records show a place of a read
            order = np.lexsort((f.b_rec[fits], -f.mapq[f.b_rec[fits]], ~f.b_aligned[fits], f.b_end[fits], own[fits]))
        order = fits[order]
        #: Bases that stand for a place of a read, sorted by read and place.
        self.base, self.base_key = order[first], key[first]
        self.last_aligned = np.full(2 * f.count, -1)
        good = self.base[f.b_aligned[self.base]]
        np.maximum.at(self.last_aligned, own[good], f.b_end[good])

    def _implied_lengths(self) -> None:
        """Joins both reads' bases on the reference position and tallies the lengths that they imply."""
        f = self.f
        base = self.base[f.b_aligned[self.base] & (f.b_place[self.base] >= 0)]
        rec = f.b_rec[base]
        _, pair = np.unique(np.stack([f.frag, f.tid], 1), axis=0, return_inverse=True)
        spot = (pair.ravel()[rec] << int(f.b_place[base].max(initial=0)).bit_length()) | f.b_place[base]
        one, two = (np.flatnonzero(f.last[rec] == k) for k in (0, 1))
        two = two[np.argsort(spot[two], kind="stable")]
        there, wanted = spot[two], spot[one]
        lo = np.searchsorted(there, wanted)
        if len(there) and (there[1:] == there[:-1]).any():
            hi = np.searchsorted(there, wanted, "right")
        else:
            hi = lo + (there[np.minimum(lo, len(there) - 1)] == wanted) if len(there) else lo
        which, i = _span_of(hi - lo)
        x, y = base[one[which]], base[two[lo[which] + i]]
        opposite = f.reverse[f.b_rec[x]] != f.reverse[f.b_rec[y]]
        x, y = x[opposite], y[opposite]
        frag, length = f.frag[f.b_rec[x]], f.b_end[x] + f.b_end[y] + 1
        order = np.argsort((frag << 34) | length, kind="stable")
        frag, length, e = frag[order], length[order], f.b_end[x][order]
        start = np.flatnonzero(np.concatenate([[True], (frag[1:] != frag[:-1]) | (length[1:] != length[:-1])])) if len(frag) else np.zeros(0, np.int64)
        self.t_frag, self.t_length = frag[start], length[start]
        self.t_n = np.diff(np.append(start, len(frag)))
        self.t_low, self.t_high = (np.minimum.reduceat(e, start), np.maximum.reduceat(e, start)) if len(start) else (start, start)
        last1, last2 = self.last_aligned[2 * self.t_frag], self.last_aligned[2 * self.t_frag + 1]
        #: Aligned bases that the tally leaves over at the worse end, and aligned bases beyond the fragment.
        self.t_reach = np.maximum(np.maximum(last1 - self.t_high, last2 - (self.t_length - 1 - self.t_low)), 0)
        self.t_past = np.maximum(last1 - self.t_length + 1, 0) + np.maximum(last2 - self.t_length + 1, 0)

    def _choose(self) -> None:
        d = self.d
        order = np.lexsort((self.t_length, -self.t_n, self.t_reach, self.t_frag))
        self.best = order[np.concatenate([[True], self.t_frag[order][1:] != self.t_frag[order][:-1]])]
        frag, length = self.t_frag[self.best], self.t_length[self.best]
        d.length[frag] = length
        len1, len2 = self.read_len[2 * frag], self.read_len[2 * frag + 1]
        lo, hi = np.maximum(0, length - len2), np.minimum(len1, length)
        enough = hi - lo >= max(1, self.o.min_overlap)
        self.best, self.c_frag, self.lo, self.hi = self.best[enough], frag[enough], lo[enough], hi[enough]

    def _at(self, side: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The base at a place of a read; -1 where there is none."""
        key = (side << 32) | np.maximum(end, 0)
        at = np.minimum(np.searchsorted(self.base_key, key), len(self.base_key) - 1)
        return np.where((self.base_key[at] == key) & (end >= 0), self.base[at], -1)

    def _compare(self) -> None:
        """All positions of the overlaps: the two bases, and whether they agree."""
        f, d = self.f, self.d
        case, i = _span_of(self.hi - self.lo)
        end, frag = self.lo[case] + i, self.c_frag[case]
        x, y = self._at(2 * frag, end), self._at(2 * frag + 1, d.length[frag] - 1 - end)
        self.over_case, self.over_one, self.over_two = case, x, y
        paired = (x >= 0) & (y >= 0)
        paired[paired] = f.b_aligned[x[paired]] & f.b_aligned[y[paired]]
        letter = lambda b: f.seq[f.seq_offs[f.b_rec[b]] + f.b_at[b]]
        clear = paired.copy()
        acgt = np.frombuffer(b"ACGT", np.uint8)
        clear[paired] = np.isin(letter(x[paired]), acgt) & np.isin(letter(y[paired]), acgt)
        self.p_case, self.p_one, self.p_two = case[clear], x[clear], y[clear]
        self.p_same = letter(self.p_one) == letter(self.p_two)
        for name, some in (("unpaired", frag[~paired]), ("ambiguous", frag[paired & ~clear]), ("compared", frag[clear]), ("match", frag[clear][self.p_same]), ("mismatch", frag[clear][~self.p_same])):
            d.counts[f"positions_{name}"] += np.bincount(some, minlength=f.count)

    def _judge(self) -> None:
        """Refuses what doesn't stand up, for the first reason that holds."""
        d, o, best, frag = self.d, self.o, self.best, self.c_frag
        width = self.hi - self.lo
        frac = (self.t_high[best] - self.t_low[best] + 1) / width
        wrong = d.counts["positions_mismatch"][frag] / np.maximum(d.counts["positions_compared"][frag], 1)
        chosen = np.full(len(d.length), -1)
        chosen[frag] = best
        rival = np.flatnonzero((chosen[self.t_frag] >= 0) & (chosen[self.t_frag] != np.arange(len(self.t_frag))))
        mine = chosen[self.t_frag[rival]]
        anchored = rival[(self.t_reach[rival] <= o.max_anchor_slack) & (self.t_past[rival] <= o.max_past_end)]
        strongest = np.full(len(d.length), -1)
        np.maximum.at(strongest, self.t_frag[anchored], self.t_n[anchored])
        apart = (self.t_high[rival] < self.t_low[mine]) | (self.t_high[mine] < self.t_low[rival])
        split = np.zeros(len(d.length), bool)
        split[self.t_frag[rival[apart & (self.t_n[rival] >= o.min_support) & (np.abs(self.t_length[rival] - self.t_length[mine]) <= o.indel_window)]]] = True
        n = self.t_n[best]
        failed = [
            n < o.min_support, self.t_past[best] > o.max_past_end, self.t_reach[best] > o.max_anchor_slack, frac < o.min_span_frac,
            wrong > o.max_mismatch_frac, (strongest[frag] >= 0) & (strongest[frag] >= o.ambiguity_ratio * n),
        ]
        reason = np.select(failed, range(len(failed)), -1)
        # an insertion or deletion that one mate shows and the other doesn't splits the positions in two
        reason[np.isin(reason, (REASONS.index("anchor_slack"), REASONS.index("ambiguous_l"))) & split[frag]] = REASONS.index("indel_disagreement")
        d.reason[frag], d.overlap[frag], d.support[frag], d.span_frac[frag] = reason, width, n, frac
        d.verdict[frag] = np.where(reason < 0, VERDICTS.index(RESOLVED), VERDICTS.index(UNRESOLVED))
        self.ok = reason < 0

    def _merge_evidence(self) -> None:
        """New qualities and bases where two observations of a base agree or don't."""
        f, o = self.f, self.o
        use = self.ok[self.p_case]
        one, two, same = self.p_one[use], self.p_two[use], self.p_same[use]
        at1, at2 = (f.seq_offs[f.b_rec[b]] + f.b_at[b] for b in (one, two))
        q1, q2 = f.qual[at1], f.qual[at2]
        new1, new2, known = q1.copy(), q2.copy(), (q1 >= 0) & (q2 >= 0)
        if o.match_qual != "none":
            to = np.maximum(q1, q2) if o.match_qual == "max" else np.minimum(q1 + q2, min(255, o.qual_cap))
            new1, new2 = (np.where(known & same, to, x) for x in (new1, new2))
        first_wins = (q1 > q2) | ((q1 == q2) & (f.mapq[f.b_rec[one]] > f.mapq[f.b_rec[two]]))
        if o.mismatch_qual != "none":
            winner = {"zero_both": np.zeros_like(q1), "zero_loser": np.maximum(q1, q2), "subtract": np.abs(q1 - q2)}[o.mismatch_qual]
            if o.mismatch_qual == "zero_loser":
                winner = np.where(first_wins, q1, q2)
            odd = known & ~same
            new1, new2 = np.where(odd, np.where(first_wins, winner, 0), new1), np.where(odd, np.where(first_wins, 0, winner), new2)
        changed = []
        for at, b, old, new in ((at1, one, q1, new1), (at2, two, q2, new2)):
            f.qual[at] = new
            frag = f.frag[f.b_rec[b]]
            self.d.counts["quals_raised"] += np.bincount(frag[new > old], minlength=f.count)
            self.d.counts["quals_lowered"] += np.bincount(frag[new < old], minlength=f.count)
            touched = new != old
            if o.mismatch_base == "set_n":
                f.seq[at[~same]] = ord("N")
                self.d.counts["bases_set_n"] += np.bincount(frag[~same], minlength=f.count)
                touched |= ~same
            changed.append(b[touched])
        self.d.edited += np.bincount(f.b_rec[np.concatenate(changed)], minlength=f.size)

    def _keep_one(self) -> None:
        """Clips the overlap from one mate, and what is past the fragment from both."""
        f, d, o = self.f, self.d, self.o
        if o.keep == "score":
            score = []
            for b in (self.over_one, self.over_two):
                some = np.flatnonzero(b >= 0)
                some = some[f.b_aligned[b[some]]]
                rec, case = f.b_rec[b[some]], self.over_case[some]
                q = self.old_qual[f.seq_offs[rec] + f.b_at[b[some]]]
                means = _mean(f.mapq[rec].astype(float), case, len(self.lo)), _mean(q[q >= 0].astype(float), case[q >= 0], len(self.lo))
                score.append((np.where(np.isnan(means[0]), -np.inf, means[0]), means[1]))
            (m1, q1), (m2, q2) = score
            use = ~np.isnan(q1) & ~np.isnan(q2)
            first = m1 + np.where(use, o.score_qual_weight * q1, 0) >= m2 + np.where(use, o.score_qual_weight * q2, 0)
        else:
            first = np.full(len(self.lo), o.keep == "r1")
        frag, first, lo, hi = self.c_frag[self.ok], first[self.ok], self.lo[self.ok], self.hi[self.ok]
        d.first_kept[frag] = first
        length = d.length[frag]
        begin = np.full(2 * f.count, 1 << 40)
        begin[2 * frag] = np.where(first, length, lo)
        begin[2 * frag + 1] = np.where(first, length - hi, length)
        side = 2 * f.frag[f.b_rec] + f.last[f.b_rec]
        gone = np.bincount(f.b_rec[f.b_aligned & (f.b_end >= begin[side])], minlength=f.size)
        self._clip(np.where(f.reverse, gone, 0), np.where(f.reverse, 0, gone))
        if o.clean_kept_3prime:
            kept = 2 * frag + np.where(first, 0, 1)
            base = self._at(kept, self.last_aligned[kept])
            rec = f.b_rec[base[base >= 0]]
            rec = rec[~d.drop[rec]]
            trim = self._terminal_indels()[rec]
            more = np.zeros((2, f.size), np.int64)
            rec, trim = rec[trim > 0], trim[trim > 0]
            turned = f.reverse[rec]
            more[0, rec] = np.where(turned, d.front[rec] + trim, 0)
            more[1, rec] = np.where(turned, 0, d.back[rec] + trim)
            self._clip(*more)

    def _clip(self, front: np.ndarray, back: np.ndarray) -> None:
        d = self.d
        d.front, d.back = np.maximum(d.front, front), np.maximum(d.back, back)
        out = (d.front + d.back >= self.f.query_length) & (d.front + d.back > 0)
        d.drop |= out
        d.front[out] = d.back[out] = 0

    def _terminal_indels(self) -> np.ndarray:
        """Aligned bases up to the innermost gap that has fewer than a window of matched bases between it and the 3' end."""
        f, window = self.f, self.o.terminal_indel_window
        matched = f.aligned_op & (f.op != ord("I"))
        m = np.where(matched, f.n, 0)
        before = _inside(m, f.cut, f.rec)
        total = np.bincount(f.rec, m, f.size).astype(np.int64)
        turned = f.reverse[f.rec]
        outer = np.where(turned, before, total[f.rec] - before - m)
        inserted = f.op == ord("I")
        gap = inserted | np.isin(f.op, [ord("D"), ord("N")])
        past = np.where(turned, f.aligned_before, f.aligned_length[f.rec] - f.aligned_before - np.where(f.aligned_op, f.n, 0)) + np.where(inserted, f.n, 0)
        use = gap & (outer < window)
        out = np.zeros(f.size, np.int64)
        np.maximum.at(out, f.rec[use], past[use])
        return out

    def _finish(self) -> None:
        """The policy for unresolved fragments, and a new primary where one was dropped."""
        f, d, o = self.f, self.d, self.o
        if o.on_unresolved == "drop":
            d.drop |= f.takes_part & (d.verdict[f.frag] == VERDICTS.index(UNRESOLVED))
        side = 2 * f.frag + f.last
        lost = np.zeros(2 * f.count, bool)
        lost[side[d.drop & f.takes_part & ~f.extra]] = True
        left = np.flatnonzero(f.takes_part & f.extra & ~d.drop & lost[side])
        offset = np.where(f.reverse, np.maximum(0, f.read_length - f.hard_lead - f.query_length), f.hard_lead)
        left = left[np.lexsort((left, offset[left], side[left]))]
        d.promote[left[np.concatenate([[True], side[left][1:] != side[left][:-1]])] if len(left) else left] = True
        tally = lambda values: np.bincount(f.frag, values, f.count).astype(np.int64)
        d.counts["bases_clipped"] += tally(d.front + d.back)
        d.counts["bases_hard_clipped"] += tally((d.front + d.back) * o.hard_clip)
        d.counts["records_dropped"] += tally(d.drop)


def decide(f: Fragments, options: Options) -> Decisions:
    return Resolver(f, options).run()


def reclipped(f: Fragments, front: np.ndarray, back: np.ndarray, hard: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """CIGARs and positions after clipping aligned bases from both ends, and how much of SEQ hard clips cut off at either end.

    Gaps that the clips lay bare go; bases that a clip takes join the soft clip beside it.
    """
    before, total = f.aligned_before, f.aligned_length[f.rec]
    lo, hi = front[f.rec], total - back[f.rec]
    here = np.where(f.aligned_op, f.n, 0)
    left = np.clip(before + here, lo, hi) - np.clip(before, lo, hi)  # what stays of an operation
    gap = np.isin(f.op, [ord(k) for k in "DNP"])
    n = np.where(f.aligned_op, left, np.where(gap, np.where((before > lo) & (before < hi), f.n, 0), 0))
    moved = np.where(f.refers & (before < hi), np.where(f.aligned_op, np.clip(lo - before, 0, f.n), np.where(before <= lo, f.n, 0)), 0)
    pos = f.pos + np.bincount(f.rec, moved, f.size).astype(np.int64)
    clip = np.isin(f.op, [ord("S"), ord("H")])
    head = clip & (before == 0)
    ends = {}
    for kind in "SH":
        for side, some in ((0, head), (1, clip & ~head)):
            ends[kind, side] = np.bincount(f.rec, np.where(some & (f.op == ord(kind)), f.n, 0), f.size).astype(np.int64)
    taken = (front, back)
    cut = []
    for side in (0, 1):
        ends["S", side] = ends["S", side] + taken[side]
        harden = (taken[side] > 0) & hard
        cut.append(np.where(harden, ends["S", side], 0))
        ends["H", side] = ends["H", side] + cut[-1]
        ends["S", side] = np.where(harden, 0, ends["S", side])
    out = []
    for r in np.flatnonzero(np.diff(f.cut) > 0).tolist():
        parts = [(ends["H", 0][r], "H"), (ends["S", 0][r], "S")]
        for j in range(f.cut[r], f.cut[r + 1]):
            if n[j]:
                op = chr(f.op[j])
                if parts[-1][1] == op:
                    parts[-1] = (parts[-1][0] + n[j], op)
                else:
                    parts.append((n[j], op))
        parts += [(ends["S", 1][r], "S"), (ends["H", 1][r], "H")]
        out.append((r, "".join(f"{k}{op}" for k, op in parts if k) or "*"))
    texts = ["*"] * f.size
    for r, text in out:
        texts[r] = text
    return texts, pos, cut[0], cut[1]


def edits_kept(md: str, ops: list[tuple[str, int]], front: int, back: int) -> int | None:
    """Mismatches and gaps that are left after clipping, by the MD tag of the whole alignment; None if it doesn't fit."""
    marks: list[int | str] = []  # for each matched base 0 or 1, for a deletion its length as text
    i = 0
    while i < len(md):
        j = i
        while j < len(md) and md[j].isdigit():
            j += 1
        if j > i:
            marks += [0] * int(md[i:j])
        elif md[i] == "^":
            j = i + 1
            while j < len(md) and md[j].isalpha():
                j += 1
            marks.append(str(j - i - 1))
        elif md[i].isalpha():
            j = i + 1
            marks.append(1)
        else:
            return None
        i = j
    stop = sum(n for o, n in ops if o in "M=XI") - back
    at = base = edits = 0
    for o, n in ops:
        if o in "M=X":
            part = marks[at : at + n]
            if len(part) < n or any(isinstance(x, str) for x in part):
                return None
            edits += sum(x for k, x in enumerate(part) if front <= base + k < stop)
            at, base = at + n, base + n
        elif o == "I":
            edits += sum(front <= base + k < stop for k in range(n))
            base += n
        elif o == "D":
            if at >= len(marks) or marks[at] != str(n):
                return None
            at += 1
            edits += n if front < base < stop else 0
    return edits


def _tag(kind: str, value) -> dict:
    return {"type": kind, "value": str(value)}


def apply(f: Fragments, d: Decisions, o: Options) -> pa.Table:
    """The fragments' table after the decisions: clipped, requalified, tagged; dropped records are left out.

    Secondary and unmapped records keep their alignments.  Records that are clipped lose
    the tags that described the alignment that was.
    """
    texts, pos, cut_front, cut_back = reclipped(f, d.front, d.back, o.hard_clip)
    keep = ~d.drop
    clipped = d.front + d.back > 0
    moved = clipped | d.drop | d.promote
    flags = np.where(d.promote, f.flags & ~SUPPLEMENTARY, f.flags)
    old = [x or "*" for x in f.table.column("cigar").to_pylist()]
    texts = [new if c else was for new, was, c in zip(texts, old, clipped.tolist(), strict=True)]
    pos = np.where(clipped, pos, f.pos)

    # SEQ and QUAL, without what hard clips cut off
    owner, place = _span_of(np.diff(f.seq_offs))
    length = np.diff(f.seq_offs)
    stays = (place >= cut_front[owner]) & (place < (length - cut_back)[owner])
    offs = np.concatenate([[0], np.cumsum(np.bincount(owner[stays], minlength=f.size))])
    seq, qual = f.seq[stays], f.qual[stays]
    missing = np.array([x in (None, "*") for x in f.table.column("seq").to_pylist()], bool)
    as_text = lambda data: pa.Array.from_buffers(pa.large_string(), f.size, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
    seq_text = as_text(seq)
    no_quals = ~f.has_quals
    held = np.repeat(f.has_quals, np.diff(offs))
    qual_offs = np.concatenate([[0], np.cumsum(np.diff(offs) * f.has_quals)]).astype(np.int32)
    quals = pa.ListArray.from_arrays(pa.array(qual_offs, pa.int32(), mask=np.append(no_quals, False)), pa.array(qual[held], pa.int32()))
    shown = as_text((np.maximum(qual, 0) + 33).astype(np.uint8))

    tags = [dict(t or []) for t in f.table.column("tags").to_pylist()]
    before = [dict(t) for t in tags] if moved.any() else tags
    for r in np.flatnonzero(f.takes_part & keep).tolist():
        _write_tags(tags[r], r, f, d, o, bool(clipped[r]))
    columns = {"flags": flags, "pos": pos, "cigar": texts, "tags": tags}
    for k in ("mate_tid", "mate_pos", "insert_size"):
        columns[k] = f.table.column(k).fill_null(-1 if k != "insert_size" else 0).to_numpy().astype(np.int64).copy()
    columns["mate_ref_name"] = f.table.column("mate_ref_name").to_pylist()
    changed = np.zeros(f.count, bool)
    changed[f.frag[moved]] = True
    if changed.any():
        _rebuild_other_alignments(f, d, columns, before, keep, changed)
        _sync_mates(f, columns, keep, changed)
    schema = f.table.schema
    new = {
        "flags": pa.array(columns["flags"]), "pos": pa.array(pos), "cigar": pa.array(columns["cigar"], pa.string()),
        "seq": pa.array(np.where(missing, "*", np.array(seq_text.to_pylist(), object)).tolist(), pa.string()) if missing.any() else seq_text,
        "quals": quals, "tags": pa.array([list(t.items()) for t in columns["tags"]], schema.field("tags").type),
        "mate_tid": pa.array(columns["mate_tid"]), "mate_pos": pa.array(columns["mate_pos"]), "insert_size": pa.array(columns["insert_size"]), "mate_ref_name": pa.array(columns["mate_ref_name"], pa.string()),
    }
    if "qual" in schema.names:
        new["qual"] = pa.array([None if n else q for n, q in zip(no_quals.tolist(), shown.to_pylist(), strict=True)], pa.string()) if no_quals.any() else shown
    arrays = [new[k].cast(schema.field(k).type) if k in new else f.table.column(k) for k in schema.names]
    return pa.table(arrays, schema=schema).filter(pa.array(keep))


#: Tags that describe an alignment as it was.
STALE = ("AS", "XA", "NM", "MD")


def _write_tags(tags: dict, r: int, f: Fragments, d: Decisions, o: Options, clipped: bool) -> None:
    p, k = o.tag_prefix, int(f.frag[r])
    for name in (*(STALE if clipped else ()), "XL", *(p + x for x in "ONSXKVv")):
        tags.pop(name, None)
    verdict = VERDICTS[d.verdict[k]]
    if verdict == NO_OVERLAP:
        tags[p + "O"] = _tag("i", 0)
    elif verdict == UNRESOLVED:
        tags[p + "V"] = _tag("Z", reason_of(d, k))
    elif verdict == RESOLVED:
        tags["XL"], tags[p + "O"], tags[p + "N"] = _tag("i", d.length[k]), _tag("i", d.overlap[k]), _tag("i", d.support[k])
        tags[p + "S"], tags[p + "X"], tags[p + "K"] = _tag("f", f"{d.span_frac[k]:g}"), _tag("i", d.counts["positions_mismatch"][k]), _tag("A", "1" if d.first_kept[k] else "2")
    if d.edited[r]:
        tags[p + "v"] = _tag("i", d.edited[r])


def reason_of(d: Decisions, k: int) -> str:
    return REASONS[d.reason[k]] if d.reason[k] >= 0 else "inconsistent_length"


def _rebuild_other_alignments(f: Fragments, d: Decisions, columns: dict, before: list[dict], keep: np.ndarray, changed: np.ndarray) -> None:
    """SA of reads of which a record moved: the other alignments, the primary first."""
    side = 2 * f.frag + f.last
    moved = np.zeros(2 * f.count, bool)
    moved[side[(d.front + d.back > 0) | d.drop | d.promote]] = True
    had = np.zeros(2 * f.count, bool)
    had[[s for s, t in zip(side.tolist(), before, strict=True) if "SA" in t]] = True
    rows = np.flatnonzero(keep & f.takes_part & (moved & had)[side])
    flags, tags = columns["flags"], columns["tags"]
    rows = rows[np.lexsort((rows, flags[rows] & SUPPLEMENTARY, side[rows]))]
    names = f.table.column("ref_name")

    def edits(r: int) -> str:
        if "NM" in tags[r]:
            return tags[r]["NM"]["value"]
        ops = [(chr(f.op[j]), int(f.n[j])) for j in range(f.cut[r], f.cut[r + 1])]
        kept = edits_kept(before[r]["MD"]["value"], ops, int(d.front[r]), int(d.back[r])) if "MD" in before[r] else None
        return str(kept) if kept is not None else before[r].get("NM", {"value": "0"})["value"]

    for s in np.unique(side[rows]):
        own = rows[side[rows] == s].tolist()
        told = [f"{names[r].as_py()},{columns['pos'][r] + 1},{'-' if flags[r] & REVERSE else '+'},{columns['cigar'][r].replace('H', 'S')},{f.mapq[r]},{edits(r)};" for r in own]
        for i, r in enumerate(own):
            tags[r].pop("SA", None)
            others = "".join(told[:i] + told[i + 1 :])
            if others:
                tags[r]["SA"] = _tag("Z", others)


def _sync_mates(f: Fragments, columns: dict, keep: np.ndarray, changed: np.ndarray) -> None:
    """Mate fields of changed fragments of which each read has one primary, both paired."""
    flags, cigar, tags = columns["flags"], columns["cigar"], columns["tags"]
    side = 2 * f.frag + f.last
    primary = np.flatnonzero(keep & (flags & (SECONDARY | SUPPLEMENTARY) == 0))
    which = np.full(2 * f.count, -1)
    which[side[primary]] = primary
    single = np.bincount(side[primary], minlength=2 * f.count) == 1
    paired = np.zeros(2 * f.count, bool)
    paired[single] = flags[which[single]] & PAIRED > 0
    ready = changed & paired.reshape(-1, 2).all(1)
    rec, op, n = operations(pa.array(cigar))
    reach = np.bincount(rec, np.where(np.isin(op, [ord(k) for k in "MDN=X"]), n, 0), f.size).astype(np.int64)
    five = np.where(f.reverse, columns["pos"] + reach - 1, columns["pos"])
    rows = np.flatnonzero(keep & ready[f.frag] & (flags & SECONDARY == 0))
    own, mate = which[side[rows]], which[side[rows] ^ 1]
    placed = (flags[own] | flags[mate]) & UNMAPPED == 0
    same = placed & (f.tid[own] == f.tid[mate])
    gap = np.where(same, five[mate] - five[own], 0)
    old = flags.copy()
    forward = np.where(old[own] & REVERSE == 0, own, mate)
    other = own + mate - forward
    faces = same & ((old[own] ^ old[mate]) & REVERSE > 0) & (five[forward] <= five[other])
    new = old[rows] & ~(MATE_REVERSE | MATE_UNMAPPED) | np.where(old[mate] & REVERSE > 0, MATE_REVERSE, 0) | np.where(old[mate] & UNMAPPED > 0, MATE_UNMAPPED, 0)
    flags[rows] = np.where(faces, new, new & ~PROPER)
    columns["mate_tid"][rows], columns["mate_pos"][rows] = f.tid[mate], columns["pos"][mate]
    columns["insert_size"][rows] = gap + np.sign(gap)
    names = f.table.column("ref_name").to_pylist()
    for r, m in zip(rows.tolist(), mate.tolist(), strict=True):
        columns["mate_ref_name"][r] = names[m]
        if "MC" in tags[r]:
            tags[r]["MC"] = _tag("Z", cigar[m])
        if "MQ" in tags[r]:
            tags[r]["MQ"] = _tag("i", f.mapq[m])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole fragments; partitions are sorted, so only the last fragment of a slice may go on in the next."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            held.append(batch.slice(at, SLICE))
            size += held[-1].nbytes
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            names = table.column("qname")
            stop = table.num_rows - 1
            while stop > 0 and names[stop - 1].as_py() == names[stop].as_py():
                stop -= 1
            if stop:
                yield table.slice(0, stop).combine_chunks()
            rest = table.slice(stop).combine_chunks()
            held, size = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _grouped(reads: DataFrame) -> DataFrame:
    return reads.repartition("qname").sortWithinPartitions("qname", "record_id")


def resolve_overlaps(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """The reads with overlaps resolved, with the same columns; order them by record_id to have the input's order."""
    schema = to_arrow_schema(reads.schema)

    def run(batches):
        for table in _chunks(batches):
            f = Fragments(table)
            yield from apply(f, decide(f, options), options).cast(schema).to_batches()

    return _grouped(reads).mapInArrow(run, reads.schema)


VERDICT = "qname string, verdict string, reason string, length int, overlap int, support int, span_frac double, mismatches int, kept_r1 boolean, counts map<string,bigint>"


def fragment_verdicts(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """A row for each fragment: what was decided, and counts."""
    spec = T._parse_datatype_string(VERDICT)
    schema = to_arrow_schema(spec)
    needed = ("record_id", "qname", "flags", "mapq", "tid", "pos", "cigar", "seq", "quals")

    def run(batches):
        for table in _chunks(batches):
            f = Fragments(table)
            d = decide(f, options)
            null = lambda values, mask: pa.array(values, mask=mask)
            values = np.stack([d.counts[k] for k in COUNTS], 1)
            some = values > 0
            counts = pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)), pa.array(np.tile(np.array(COUNTS, object), f.count)[some.ravel()], pa.string()), pa.array(values[some]))
            columns = [
                f.qnames, pa.array([VERDICTS[v] for v in d.verdict]), pa.array([reason_of(d, k) if v == VERDICTS.index(UNRESOLVED) else None for k, v in enumerate(d.verdict.tolist())], pa.string()),
                null(d.length, d.length < 0), pa.array(d.overlap), pa.array(d.support), pa.array(d.span_frac), pa.array(d.counts["positions_mismatch"]), null(d.first_kept > 0, d.first_kept < 0), counts,
            ]
            yield from pa.table([c.cast(t.type) for c, t in zip(columns, schema, strict=True)], schema=schema).to_batches()

    return _grouped(reads.select(*needed)).mapInArrow(run, spec)


def statistics(verdicts: DataFrame) -> DataFrame:
    """(section, key, value): counts, reasons, rates per million, and histograms of lengths and overlaps."""
    entry = lambda section, key, n=F.lit(1), of=F.lit(0): F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("bigint").alias("n"), of.cast("bigint").alias("of"))
    resolved = F.col("verdict") == RESOLVED
    count = lambda name: F.coalesce(F.col("counts")[name], F.lit(0))
    rate = lambda n, of: entry("rate_ppm", F.lit("mismatch"), n, of)
    entries = F.concat(
        F.transform(F.map_entries("counts"), lambda e: entry("counts", e["key"], e["value"])),
        F.array(entry("templates", F.col("verdict")), rate(count("positions_mismatch"), count("positions_compared"))),
        F.when(F.col("reason").isNotNull(), F.array(entry("unresolved", F.col("reason")))).otherwise(F.array()),
        F.when(resolved, F.array(entry("length", F.col("length")), entry("overlap", F.col("overlap")))).otherwise(F.array()),
    )
    none = verdicts.sparkSession.range(1).select(rate(F.lit(0), F.lit(0)).alias("e"))  # the rate has a row without verdicts too
    out = verdicts.select(F.explode(entries).alias("e")).unionByName(none).groupBy("e.section", "e.key").agg(F.sum("e.n").alias("n"), F.sum("e.of").alias("of"))
    value = F.when(F.col("section") == "rate_ppm", (F.col("n") * 1_000_000 / F.nullif(F.col("of"), F.lit(0))).cast("bigint")).otherwise(F.col("n"))
    return out.select("section", "key", value.alias("value"))


def with_edit_tags(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """NM and MD of aligned reads, counted from the reference; other records keep theirs.

    reads: as a source gives them; refs: (contig, length, seq).
    """
    from baseloom.operators.walk import beside, with_geometry, with_reference

    fields = reads.columns
    mapped = reads.filter("cigar IS NOT NULL AND cigar <> '*' AND seq <> '*'")
    rest = reads.filter("cigar IS NULL OR cigar = '*' OR seq IS NULL OR seq = '*'")
    ready = with_reference(with_geometry(mapped), refs, 0).withColumn("walk_reversed", F.lit(False))

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        edits, md = edit_texts(columns_of(batch, Steps(0, 0, insertions=True)), batch.num_rows)
        return {"_nm": pa.array(edits, pa.int64()), "_md": md}

    told = beside(ready, compute, "_nm bigint, _md string")
    one = lambda name, kind, value: F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))
    other = F.map_filter("tags", lambda k, _: ~k.isin("NM", "MD"))
    told = told.withColumn("tags", F.map_concat(other, one("NM", "i", F.col("_nm")), one("MD", "Z", F.col("_md"))))
    return told.select(*fields).unionByName(rest)


#: Names of codesets as bytes, cut by first.
_NAMES = [K.name_of(k).encode() for k in range(256)]
_NAME_CUT = np.concatenate([[0], np.cumsum([len(x) for x in _NAMES])])
_NAME_BYTES = np.frombuffer(b"".join(_NAMES), np.uint8)
_TENS = 10 ** np.arange(19, dtype=np.int64)


def edit_texts(c: Columns, records: int) -> tuple[np.ndarray, pa.Array]:
    """(number of edited bases, MD) of each record of columns that show inserted bases and no flanks."""
    skip, inserted, deleted = c.rd == K.SKIP, c.rf == K.GAP, c.rd == K.GAP
    wrong = ~(skip | inserted | deleted) & (c.rd != c.rf)
    edits = np.bincount(c.rec[(wrong | inserted | deleted) & ~skip], minlength=records)
    at = np.flatnonzero(~skip & ~inserted)
    rec, gone = c.rec[at], deleted[at]
    cut = _cut(rec, records)
    event = np.flatnonzero(wrong[at] | gone)
    of, gone = rec[event], gone[event]
    fresh = np.ones(len(event), bool)  # whether an event is the first of its record
    fresh[1:] = of[1:] != of[:-1]
    run = event - np.where(fresh, cut[of], np.concatenate([[0], event[:-1] + 1]))  # matched bases before an event
    goes_on = np.zeros(len(event), bool)
    goes_on[1:] = gone[1:] & gone[:-1] & ~fresh[1:] & (run[1:] == 0)
    # a token for each event, and one for what is left at a record's end
    last = np.full(records, -1)
    last[of] = event
    left = cut[1:] - np.where(last >= 0, last + 1, cut[:-1])
    tokens = np.bincount(of, minlength=records) + 1
    ends = np.cumsum(tokens) - 1
    places = np.ones(int(tokens.sum()), bool)
    places[ends] = False
    places = np.flatnonzero(places)
    number, code = np.zeros(int(tokens.sum()), np.int64), np.zeros(int(tokens.sum()), np.int64)
    number[places], number[ends] = np.where(goes_on, -1, run), left
    code[places] = c.rf[at][event]
    marked = np.zeros(len(number), bool)
    marked[places] = gone & ~goes_on
    digits = np.where(number < 0, 0, np.maximum(np.searchsorted(_TENS, number, "right"), 1))
    named = np.zeros(len(number), np.int64)
    named[places] = np.diff(_NAME_CUT)[code[places]]
    size = digits + marked + named
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1], np.uint8)
    for k in range(int(digits.max(initial=0))):
        some = np.flatnonzero(digits > k)
        out[begin[some] + digits[some] - 1 - k] = number[some] // _TENS[k] % 10 + ord("0")
    some = np.flatnonzero(marked)
    out[begin[some] + digits[some]] = ord("^")
    for k in range(int(named.max(initial=0))):
        some = np.flatnonzero(named > k)
        out[begin[some] + digits[some] + marked[some] + k] = _NAME_BYTES[_NAME_CUT[code[some]] + k]
    offs = begin[np.concatenate([[0], ends + 1])]
    return edits, pa.Array.from_buffers(pa.large_string(), records, [None, pa.py_buffer(offs), pa.py_buffer(out)]).cast(pa.string())
