"""Random hits, and every count and check over them written out with dictionaries."""

import random
from collections import Counter, defaultdict

NAMES = ("CG", "TG", "CHG", "CHH", "THG", "THH", "other")
GROUPS = {"mCG": (("CG",), ("TG",)), "mCH": (("CHG", "CHH"), ("THG", "THH"))}
SCHEMA = "qname string, mate boolean, XB string, name string, contig string, refr_pos bigint, strand string, qual int"


def hits(seed, n=260, reads=24):
    """(qname, mate, block, name, contig, position, strand, quality); a read is of one block, and few sites are met often."""
    r = random.Random(seed)
    home = [f"cell{r.randrange(4)}" for _ in range(reads)]
    taste = [r.random() for _ in range(reads)]
    out = []
    for _ in range(n):
        k = r.randrange(reads)
        name = r.choice(("CG", "CHG", "CHH") if r.random() < taste[k] else ("TG", "THG", "THH", "other"))
        out.append((f"read{k}", k % 2 == 0, home[k], name, f"chr{r.randrange(1, 4)}", 10 * r.randrange(1, 9) + (1 if r.random() < 0.3 else 0), r.choice("+-"), r.randrange(10, 40)))
    return out


def sides(hit):
    """(relation, 1 if on its main side) of a hit."""
    return [(m, int(hit[3] in main)) for m, (main, other) in GROUPS.items() if hit[3] in main + other]


def tally(rows, key):
    """{(key, relation): (num, den)}."""
    out = defaultdict(lambda: [0, 0])
    for h in rows:
        for relation, main in sides(h):
            got = out[(*key(h), relation)]
            got[0] += main
            got[1] += 1
    return {k: tuple(v) for k, v in out.items()}


def read(h):
    return (h[0],)


def block(h):
    return (h[2],)


def site(merged=None):
    """Sites of hits; of the merged relation minus-strand ones are moved by one."""

    def of(h):
        if any(r == merged for r, _ in sides(h)):
            return (h[2], h[4], h[5] - (h[6] == "-"), "+")
        return (h[2], h[4], h[5], h[6])

    return of


def longest_runs(rows, relation):
    """The longest run of main-side calls along each read, positions in order, the other side first where both are."""
    calls = defaultdict(set)
    for h in rows:
        for r, main in sides(h):
            if r == relation:
                calls[h[0]].add((h[5], main))
    out = {}
    for q, found in calls.items():
        best = run = 0
        for _, main in sorted(found):
            run = run + 1 if main else 0
            best = max(best, run)
        out[q] = best
    return out


def extent(rows, relation):
    """{block: (distinct reads, distinct sites)}."""
    reads, sites = defaultdict(set), defaultdict(set)
    for h in rows:
        if any(r == relation for r, _ in sides(h)):
            reads[h[2]].add(h[:2])
            sites[h[2]].add(h[4:7])
    return {b: (len(reads[b]), len(sites[b])) for b in reads}


def without(rows, bad_reads=(), bad_blocks=()):
    return [h for h in rows if h[0] not in bad_reads and h[2] not in bad_blocks]


def pooled(sites, relation, parts):
    """Sums over blocks, and over what else isn't in parts (indices into a site)."""
    num, den = Counter(), Counter()
    for (*key, r), (n, d) in sites.items():
        if r == relation:
            at = tuple(key[i] for i in parts)
            num[at] += n
            den[at] += d
    return {k: (num[k], den[k]) for k in sorted(den)}
