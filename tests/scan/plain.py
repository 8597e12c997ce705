"""A walk and a matcher of one record at a time, written for reading, and random records for them."""

import random

from baseloom.functions import codes as K

READS = "record_id bigint, qname string, flags int, ref_name string, pos bigint, mapq int, cigar string, seq string, quals array<int>, tags map<string,struct<type:string,value:string>>"


def genomes(seed, n=3, size=160):
    r = random.Random(seed)
    return {f"g{i}": "".join(r.choices("ACGTN", [5, 7, 7, 5, 1], k=size)) for i in range(n)}


def records(seed, refs, n=60, kinds="MDIN"):
    """(qname, flags, contig, pos, [(op, n)], seq): operations fit their sequences, and reads mostly agree with the contig."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        contig = r.choice(list(refs))
        start = at = r.randint(0, 20) if r.random() < 0.3 else r.randint(0, 60)
        ops, seq = [], ""
        if r.random() < 0.3:
            ops.append(("H", r.randint(1, 3)))
        if r.random() < 0.4:
            k = r.randint(1, 6)
            ops.append(("S", k))
            seq += "".join(r.choices("ACGT", k=k))
        for step in range(r.randint(1, 4)):
            if step:
                kind, k = r.choice(kinds), r.randint(1, 9)
                if kind != "M":
                    ops.append((kind, k))
                    seq += "".join(r.choices("ACGT", k=k)) if kind == "I" else ""
                    at += k if kind in "DN" else 0
            k = r.randint(1, 14)
            ops.append((r.choice("MM=X"), k))
            seq += "".join(c if c != "N" and r.random() < 0.8 else r.choice("ACGT") for c in refs[contig][at : at + k])
            at += k
        if r.random() < 0.4:
            k = r.randint(1, 6)
            ops.append(("S", k))
            seq += "".join(r.choices("ACGT", k=k))
        if r.random() < 0.2:
            ops.append(("H", 2))
        out.append((f"q{i}", r.choice([0, 16, 128, 144]), contig, start, ops, seq))
    return out


def frame(spark, rows):
    cigar = lambda ops: "".join(f"{n}{op}" for op, n in ops)
    full = [(i, q, f, c, p, 60, cigar(ops), s, [(7 * i + j) % 41 for j in range(len(s))] if i % 5 else None, {}) for i, (q, f, c, p, ops, s) in enumerate(rows)]
    return spark.createDataFrame(full, READS)


def contigs(spark, refs):
    return spark.createDataFrame([(k, len(v), v) for k, v in refs.items()], "contig string, length bigint, seq string")


def bottom(flags):
    return bool(flags & 16) != bool(flags & 128)


def columns(record, refs, flank, context, insertions, quals):
    """[(rd, rf, pos, off, q)] in walk order, with positions in SEQ turned at the end."""
    _, flags, contig, pos, ops, seq = record
    genome = refs[contig]
    base = lambda p: K.code_of(genome[p]) if 0 <= p < len(genome) else K.PAD
    turned = bottom(flags)
    visible = [(op, n) for op, n in ops if op != "H"]
    lead = visible[0][1] if visible[0][0] == "S" else 0
    trail = visible[-1][1] if len(visible) > 1 and visible[-1][0] == "S" else 0
    body, p, s = [], pos, 0
    for op, n in ops:
        behind = s if turned else s - 1
        if op in "M=X":
            for k in range(n):
                body.append((K.code_of(seq[s + k]), base(p + k), p + k, s + k, quals[s + k] if quals else None))
            p, s = p + n, s + n
        elif op == "D":
            body += [(K.GAP, base(p + k), p + k, behind, None) for k in range(n)]
            p += n
        elif op == "N":
            shown = list(range(p, p + n))
            if n > 2 * context:
                hole = p + n - context - 1 if turned else p + context
                shown = [*range(p, p + context), None, *range(p + n - context, p + n)]
            body += [(K.SKIP, K.SKIP if x is None else base(x), hole if x is None else x, behind, None) for x in shown]
            p += n
        elif op == "I":
            if insertions:
                body += [(K.code_of(seq[s + k]), K.GAP, p if turned else p - 1, s + k, quals[s + k] if quals else None) for k in range(n)]
            s += n
        elif op == "S":
            s += n
    left = [(K.CLIP if k <= lead else K.PAD, base(pos - k), pos - k, lead - k if k <= lead else None, None) for k in range(flank, 0, -1)]
    right = [(K.CLIP if k < trail else K.PAD, base(p + k), p + k, len(seq) - trail + k if k < trail else None, None) for k in range(flank)]
    out = left + body + right
    if turned:
        out = [(K.complement(a), K.complement(b), c, None if d is None else len(seq) - 1 - d, e) for a, b, c, d, e in reversed(out)]
    return out


def ends(record, off):
    _, flags, _, _, ops, seq = record
    five = len(seq) - 1 - off if flags & 128 else off
    hard = [ops[0][1] if ops[0][0] == "H" else 0, ops[-1][1] if len(ops) > 1 and ops[-1][0] == "H" else 0]
    if flags & 16:
        hard.reverse()
    return five + hard[0], len(seq) - 1 - five + hard[1]


def hits(record, cols, queries):
    """[(name, read_5p, read_3p, refr_pos, qual, read_base, refr_base)] in order."""
    read, refr = [c[0] for c in cols], [c[1] for c in cols]
    out = []
    for last in range(len(cols)):
        for q in queries.queries.values():
            start = last - q.span + 1
            if start < 0 or not q.matches(read, refr, start):
                continue
            rd, rf, pos, off, qual = cols[start + q.anchor]
            five, three = (None, None) if rd == K.PAD else ends(record, off)
            out.append((q.name, five, three, pos, qual, K.name_of(rd), K.name_of(rf)))
    return out
