"""Set-similarity join of documents by token-combination prefixes.

A document is the set of its word shingles.  All shingles have a global order: those of
one set alone, those of several, then frequent ones, each by hash.  So the first few
shingles of a set, its prefix, are its rarest; any partner shares one of them.  Sets
with enough rare shingles index these one by one, if several sets may have them.

Other sets also extend their prefix into the frequent shingles, which are indexed in
combinations.  Frequent shingles fall into classes by hash, and the key of a class is
the combination of all that a set has of it.  Two similar sets differ in a bounded
number of shingles, each of which spoils one class at most; so one of the first classes
that aren't empty, one more than may be spoilt, has the same combination in both.  How many classes
there are depends on the size, so a set is indexed for its own level of sizes and for
the next.  A set with too few classes that aren't empty is indexed again with twice as
many, and so on until each shingle stands alone; partners meet where one has enough.

Which shingles several sets have is read from a bit table by hash, which is broadcast;
its size follows the input up to a bound.  Where it is too full it sends more shingles
than needed into the index, but it never misses one, so results don't depend on it.

Equal sets are one node.  Nodes that share a key are paired with the key's *pivot*
alone, the node with the smallest share of shingles of its own: what others are copies
of.  That joins most of them.  Where a pivot's nodes are still in several components,
those outside the largest one are paired with the others; the group is dealt in blocks,
and in a block, sorted, only pairs are looked at whose distances from the pivot allow a
link.  Pairs are verified on whole sets, unless sizes rule them out, or sketches do: of the
parities of hashed shingles, no more differ than shingles do.

Components need no more than that.  For numbers of links all pairs of nodes that share
a key and whose sizes allow it are compared instead, by blocks of the nodes of a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.llm import _vector as V
from baseloom.llm._hot import join_hot
from baseloom.llm._scratch import Scratch
from baseloom.llm._windows import FLUSH, keyed, partitions
from baseloom.llm.components import components

SHINGLE = 5
PERCENT = 75
#: A shingle is frequent from this many sets on, and from one in 2**20 of all shingles on; so there are 2**20 frequent ones at most.
FREQUENT = 48
FREQUENT_SHARE = 1 << 20
#: Bound of the bit table: 128 MB.
MAX_BITS = 1 << 30
#: Classes of frequent shingles, as a share of a level's largest size.
CLASSES = 0.35
#: Nodes in a block of a key or pivot, on average.
BLOCK_NODES = 256


def shingles(block: V.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each text, sorted."""
    low = V.LOWER[block.data]
    starts, ends, first = V.split_words(V.Block(block.rows, low, block.offs))
    words = V.spans(low, starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(words))
    ok = (k - first[doc] + size <= count[doc])[: max(0, len(words) - size + 1)]
    h, doc = V.windows(words, size)[ok], doc[: len(ok)][ok]
    for few in range(1, size):  # a text of fewer words is one shingle
        short = np.flatnonzero(count == few)
        if len(short):
            h, doc = np.concatenate([h, V.windows(words, few, few)[first[short]]]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


def set_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, independent of order."""
    total = [np.concatenate([[np.uint64(0)], np.cumsum(V.mix(h ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (V.BASE_1, V.BASE_2)]
    return tuple(V.mix(t[first[1:]] - t[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64) for t in total)


def lacking(n: np.ndarray | int, percent: int):
    """How many of n shingles a partner may lack."""
    return n - -(-n * percent // 100)


def level(n: int, percent: int) -> tuple[int, int, int]:
    """(level, its largest size, the next level's); similar sets are of the same level or of neighbouring ones."""
    at, most = 0, 1
    while True:
        after = max(most + 1, -(-100 * most // percent))
        if n <= most:
            return at, most, after
        at, most = at + 1, after


def combined_keys(rare: int, several: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set with fewer rare shingles, several of them in other sets, than its prefix has; frequent ones sorted."""
    n = rare + len(frequent)
    at, own, after = level(n, percent)
    out = [V.mix(several)]
    for lev, most in ((at, own), (at + 1, after)):  # a partner's size may be of the next level; both then use the larger one's
        # rare shingles that might be shared are indexed one by one; else all of them are among those that differ
        differ = (100 - percent) * (n + most) // (100 + percent) - rare
        if differ < 0 or not len(frequent):
            continue
        classes = int(CLASSES * most) + 2
        while True:
            alone = classes >= 4 * most
            of = np.arange(len(frequent)) if alone else ((V.mix(frequent ^ np.uint64(0x51ED)) >> np.uint64(33)) % np.uint64(classes)).astype(np.int64)
            order = np.lexsort((frequent, of))
            new = np.ones(len(of), bool)
            new[1:] = of[order[1:]] != of[order[:-1]]
            starts = np.flatnonzero(new)
            # a combination's hash: the sum of its mixed shingles, for this level and number of classes
            sums = np.add.reduceat(V.mix(frequent[order] + np.uint64(lev)), starts)
            out.append(V.mix(sums ^ V.mix(np.full(1, (lev << 40) + (0 if alone else classes) + 1, np.uint64)))[: differ + 1])
            if alone or len(starts) > differ:
                break
            classes *= 2
    return np.concatenate(out)


@dataclass
class Classes:
    """Which shingles several sets may have (a bit table), and which are frequent (sorted heads)."""

    slices: int
    bits: np.ndarray
    frequent: np.ndarray

    @property
    def slice_bits(self) -> int:
        return (self.slices - 1).bit_length()

    def split(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slice, the 32 bits after it)."""
        head = h >> np.uint64(32 - self.slice_bits)
        return (head >> np.uint64(32)).astype(np.int64), head.astype(np.uint32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """0: of one set alone; 1: maybe of several; 2: frequent."""
        part, tail = self.split(h)
        per_slice = len(self.bits) * 8 // self.slices
        at = part * per_slice + (tail & np.uint32(per_slice - 1))
        out = ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int8)
        if len(self.frequent):
            head = h >> np.uint64(32 - self.slice_bits)
            out[self.frequent[np.minimum(np.searchsorted(self.frequent, head), len(self.frequent) - 1)] == head] = 2
        return out


def index_keys(h: np.ndarray, first: np.ndarray, classes: Classes, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, text of each, shingles of each text that other sets may have) for texts with distinct shingles."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    kind = classes.of(h)
    order = np.lexsort((h, kind, doc))
    h, kind = h[order], kind[order]
    place = np.arange(len(h)) - first[:-1][doc]
    need = lacking(n, percent) + 1
    rare = np.bincount(doc[kind < 2], minlength=len(n))
    enough = rare >= need
    single = enough[doc] & (kind == 1) & (place < need[doc])
    keys, owner = [V.mix(h[single])], [doc[single]]
    for d in np.flatnonzero(~enough & (n > 0)):
        own, k = h[first[d] : first[d + 1]], kind[first[d] : first[d + 1]]
        got = combined_keys(int(rare[d]), own[k == 1], own[k == 2], percent)
        keys.append(got)
        owner.append(np.full(len(got), d))
    return np.concatenate(keys), np.concatenate(owner), np.bincount(doc[kind > 0], minlength=len(n))


class _Sets:
    """Distinct sets of the texts that a task has read since the last flush."""

    def __init__(self, size: int):
        self.size = size
        self.seen: set[tuple[int, int]] = set()

    def read(self, block: V.Block):
        h, first = shingles(block, self.size)
        a, b = set_hashes(h, first)
        fresh = np.zeros(len(a), bool)
        for i, key in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if first[i + 1] > first[i] and key not in self.seen:
                self.seen.add(key)
                fresh[i] = True
        return h, first, a, b, fresh


def described(texts: DataFrame, size: int) -> DataFrame:
    """For each row its number of shingles and its set's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rks = V.idents(batch)
            for block in V.blocks(batch):
                h, first = shingles(block, size)
                a, b = set_hashes(h, first)
                columns = {"id": ids[block.rows], "rk": rks[block.rows], "n": np.diff(first), "a": a, "b": b}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    return texts.mapInArrow(run, "id bigint, rk bigint, n bigint, a bigint, b bigint")


def shingle_classes(texts: DataFrame, size: int, total: int, least: int, scratch: Scratch) -> Classes:
    """Counts all shingles by their first bits, slice by slice, and collects a bit for those that come twice.

    A task sends each shingle of the sets that it holds once, with its count if that is
    above one.  Equal sets are counted once for each task's flush.
    """
    tasks = partitions(texts)
    slices = 1 << max(6, min(14, (4 * tasks - 1).bit_length()))
    per_slice = max(64, min(MAX_BITS, 1 << max(0, 2 * total - 1).bit_length()) // slices)
    empty = Classes(slices, np.zeros(slices * per_slice // 8, np.uint8), np.zeros(0, np.uint64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, size_held = _Sets(size), [], 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            sets.seen.clear()
            part, tail = empty.split(h)
            cuts = np.searchsorted(part, np.arange(slices + 1))
            several = c > 1
            often = np.concatenate([[0], np.cumsum(several)])[cuts]
            return pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(slices, dtype=np.int32)), "all": V.binary(tail, cuts), "often": V.binary(tail[several], often), "count": V.binary(c[several].astype(np.int32), often)})

        for batch in batches:
            for block in V.blocks(batch):
                h, first, _, _, fresh = sets.read(block)
                held.append(h[np.repeat(fresh, np.diff(first))])
                size_held += len(held[-1])
                if size_held >= 4 * FLUSH:
                    yield flush()
                    size_held = 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                held.setdefault(k, []).append(tuple(V.unpacked(batch.column(j).slice(i, 1), t) for j, t in ((1, np.uint32), (2, np.uint32), (3, np.int32))))
        while held:
            k, got = held.popitem()
            every = np.sort(np.concatenate([x for x, _, _ in got]))
            often, more = np.concatenate([x for _, x, _ in got]), np.concatenate([x for _, _, x in got])
            del got
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            kinds, c = every[starts], np.diff(np.append(starts, len(every)))
            np.add.at(c, np.searchsorted(kinds, often), more - 1)
            bits = np.zeros(per_slice, bool)
            bits[(kinds[c > 1] & np.uint32(per_slice - 1)).astype(np.int64)] = True
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "often": pa.array([kinds[c >= least].tobytes()], pa.binary())})

    sent = texts.mapInArrow(send, "slice int, `all` binary, often binary, count binary").repartition(tasks, "slice")
    table, heads = empty.bits.reshape(slices, -1), []
    counted = scratch.write(sent.mapInArrow(count, "slice int, bits binary, often binary"))
    for row in counted.toLocalIterator():
        table[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
        heads.append((np.uint64(row["slice"]) << np.uint64(32)) | np.frombuffer(row["often"], np.uint32).astype(np.uint64))
    return Classes(slices, table.reshape(-1), np.sort(np.concatenate(heads)) if heads else empty.frequent)


#: Distinct sets that a task remembers, so that copies don't repeat their keys.
REMEMBERED = 200_000


#: Words of a sketch, of 64 parities each.
SKETCH_WORDS = 32


def sketches(owner: np.ndarray, items: np.ndarray, count: int) -> np.ndarray:
    """Words of the sketches of count sets; each item turns one bit of its owner's."""
    h, out = V.mix(items), np.zeros(count * SKETCH_WORDS, np.uint64)
    word = (h >> np.uint64(6)) % np.uint64(SKETCH_WORDS)
    np.bitwise_xor.at(out, owner * SKETCH_WORDS + word.astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out


def indexed(texts: DataFrame, size: int, percent: int, classes) -> DataFrame:
    """(node, a, b, n, s, keys, shared, sketch) of the sets with index keys; shared are the items that other sets may have, s their number.

    A node is a number of its own.  Tasks give a set once, but several tasks may give it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, node = _Sets(size), TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in V.blocks(batch):
                if len(sets.seen) > REMEMBERED:
                    sets.seen.clear()
                h, first, a, b, fresh = sets.read(block)
                n = np.diff(first)
                h, first = h[np.repeat(fresh, n)], np.concatenate([[0], np.cumsum(n[fresh])])
                keys, owner, s = index_keys(h, first, classes.value, percent)
                some = np.unique(owner)
                if not len(some):
                    continue
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                use = np.ones(len(keys), bool)
                use[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                keys, owner = keys[use], owner[use]
                mine = np.zeros(len(first) - 1, bool)
                mine[some] = True
                sizes = np.diff(first)
                items = h[np.repeat(mine, sizes)]
                several = classes.value.of(items) > 0
                lists = {
                    "keys": (np.searchsorted(owner, np.append(some, len(mine))), keys),
                    "shared": (np.concatenate([[0], np.cumsum(several)])[np.concatenate([[0], np.cumsum(sizes[some])])], items[several]),
                }
                lists["sketch"] = (np.arange(len(some) + 1) * SKETCH_WORDS, sketches(np.repeat(np.arange(len(some)), sizes[some])[several], items[several], len(some)))
                columns = {"node": np.arange(node, node + len(some)), "a": a[fresh][some], "b": b[fresh][some], "n": sizes[some].astype(np.int64), "s": s[some].astype(np.int64)}
                node += len(some)
                columns = {k: pa.array(v) for k, v in columns.items()}
                columns |= {k: pa.ListArray.from_arrays(pa.array(c.astype(np.int32)), pa.array(v.view(np.int64))) for k, (c, v) in lists.items()}
                yield pa.RecordBatch.from_pydict(columns)

    return texts.mapInArrow(run, "node bigint, a bigint, b bigint, n bigint, s bigint, keys array<bigint>, shared array<bigint>, sketch array<bigint>")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs, a written table of (x, y, salt), with k, the size of the intersection, nx and ny.

    Only what other sets may have can be in an intersection, so no more is read.  Pairs
    of the same y are dealt by salt, and y's set goes to each salt.
    """
    x = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("shared").alias("xs"))
    y = pairs.select("y", "salt").distinct().join(sets.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("shared").alias("ys")), "y")
    both = pairs.join(x, "x").join(y, ["y", "salt"])
    return both.select("x", "y", F.size(F.array_intersect("xs", "ys")).alias("k"), "nx", "ny")


def _similar(percent: int) -> F.Column:
    return F.col("k") * 100 >= percent * (F.col("nx") + F.col("ny") - F.col("k"))


def jaccard_join(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id", frequent: int = FREQUENT, count_links: bool = True, block: int = BLOCK_NODES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and, if links are counted, n_links.

    Two rows link when their sets' intersection is at least that percentage of their
    union.  component_id is the smallest id reachable; n_links counts the unequal
    sets that link with a row's set, all of them, so its cost grows with the square of a
    group of similar sets.  Texts with fewer words than a shingle have one shingle, the whole; null
    texts and texts without words have none and link with nothing.  Null ids count as
    smaller than all others.  Rows with equal ids are linked only by their texts.
    Shingles, and sets, compare by 64 bits of hash.  Other columns are ignored.
    """
    out = _members(keyed(docs, text_col, id_col).select("id", "rk", "text"), percent, size, frequent, block if count_links else None)
    return out.select(F.nullif("id", F.lit(V.NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("least.id", F.lit(V.NULL_ID)).alias("component_id"), *["n_links"] * count_links)


def near_dedup(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """The row of smallest id of each component, with all columns of the input.

    Rows without words are linked with nothing and stay.  Of rows that share id and
    text one stays.
    """
    ident, text = F.col(f"`{id_col}`").cast("bigint"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(ident, F.lit(V.NULL_ID)).alias("id"), F.xxhash64(ident, text).alias("rk"))
    members = _members(keyed(docs, text_col, id_col).select("id", "rk", "text"), percent, size, frequent)
    staying = Scratch(docs.sparkSession).write(members.filter("n = 0 OR (id = least.id AND rk = least.rk)").groupBy("id", "rk").agg(F.count("*").alias("m"), F.max("n").alias("n")))
    kept = rows.join(staying.hint("shuffle_hash"), ["id", "rk"])
    if not staying.filter("m > 1 AND n > 0").isEmpty():
        again = kept.filter("m > 1 AND n > 0").groupBy("id", "rk").agg(F.first("row").alias("row"))
        kept = kept.filter("m = 1 OR n = 0").select("row").union(again.select("row"))
    return kept.select("row.*")


def _members(texts: DataFrame, percent: int, size: int, frequent: int, block: int | None = None) -> DataFrame:
    """(id, rk, n, least) for each row, and n_links with a block; least is the first (id, rk) of its component."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, 100 at most")
    spark = texts.sparkSession
    scratch = Scratch(spark)
    thin = scratch.write(described(texts, size))
    total, rows = thin.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    kinds = spark.sparkContext.broadcast(shingle_classes(texts, size, total, max(frequent, -(-total // FREQUENT_SHARE)), scratch))
    sets = scratch.write(indexed(texts, size, percent, kinds))
    kinds.destroy()
    nodes = scratch.write(sets.drop("shared").dropDuplicates(["a", "b"]))
    index, sets = nodes.select("node", "n", "s", F.explode("keys").alias("key")), sets.select("node", "n", "shared")
    if block:
        links = _all_links(scratch, index, sets, percent, block)
    else:
        links = _joining_links(scratch, index, nodes, sets, percent)
    comps = components(links, scratch)

    classes = scratch.write(thin.filter("n > 0").groupBy("a", "b").agg(F.min(F.struct("id", "rk")).alias("rep"), F.count("*").alias("copies")))
    linked = classes.join(nodes.select("a", "b", "node").join(comps, "node"), ["a", "b"])
    least = linked.groupBy("comp").agg(F.min("rep").alias("least"), F.count("*").alias("members"))
    named = join_hot(scratch.write(linked), least, ["comp"], "members", rows)
    if block:
        degree = links.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        named = named.join(degree, "node")
    columns = ["a", "b", "least", "copies", *["n_links"] * bool(block)]
    named = scratch.write(named.select(*columns))
    alone = classes.join(named.select("a", "b"), ["a", "b"], "left_anti").withColumns({"least": F.col("rep"), "n_links": F.lit(0).cast("bigint")})
    out = join_hot(thin, scratch.write(named.unionByName(alone.select(*columns))), ["a", "b"], "copies", rows, "left")
    return out.select("id", "rk", "n", F.coalesce("least", F.struct("id", "rk")).alias("least"), *[F.coalesce("n_links", F.lit(0)).alias("n_links")] * bool(block))


def _needed(percent: int) -> str:
    """What two sets need in common, times 100 + percent."""
    return f"{percent} * (n + pn)"


def _fits(percent: int) -> F.Column:
    """Whether two sets may be similar by their sizes and what others may have of them."""
    return F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn) AND {100 + percent} * least(s, ps) >= {_needed(percent)}")


def _all_links(scratch: Scratch, index: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """All links between nodes in index, which has (key, node, s, n); each pair of blocks of a key meets once."""
    blocks = index.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key", "m", F.ceil(F.col("m") / block).cast("bigint").alias("blocks"))
    dealt = scratch.write(index.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks")))
    x = dealt.select("key", "node", "s", "n", "m", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    y = dealt.select("key", F.col("node").alias("pivot"), F.col("s").alias("ps"), F.col("n").alias("pn"), F.explode(F.sequence(F.lit(0).cast("bigint"), "own")).alias("i"), F.col("own").alias("j"))
    pairs = x.join(y, ["key", "i", "j"]).filter("i < j OR node < pivot").filter(_fits(percent))
    pairs = pairs.select(F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y"))
    pairs = scratch.write(pairs.distinct().withColumn("salt", F.lit(0).cast("bigint")))
    return scratch.write(compared(pairs, sets).filter(_similar(percent)).select("x", "y"))


def _salts(size: F.Column, block: int = BLOCK_NODES) -> F.Column:
    """A power of two, one for each block of so many on average; powers, so that groups of about the same size agree."""
    return F.pow(2, F.ceil(F.log2(F.greatest(F.lit(1.0), size / block)))).cast("bigint")


def _turned() -> F.Column:
    """In how many parities a set's sketch and its pivot's differ."""
    return sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("psketch")[i])) for i in range(SKETCH_WORDS)).cast("bigint")


def _may_link(percent: int) -> F.Column:
    """Whether sizes and sketches, of which so many parities are turned, allow that sets (n, s) and (pn, ps) are similar."""
    # what differs: at most so much in all, of which what no other set may have is known
    differ = F.expr(f"floor({100 - percent} * (n + pn) / {100 + percent}) - (n - s) - (pn - ps)")
    return _fits(percent) & (F.col("turned") <= differ)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by some columns, cut anew where these change."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in by]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = int(np.argmax(same))
        if cut or held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != v[0] for k, v in zip(by, keys, strict=True)):
            if done := [*held, *[batch.slice(0, cut)] * bool(cut)]:
                yield pa.Table.from_batches(done)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


#: Pairs that are looked at together.
PAIRS = 1 << 16


def _pairs_of_blocks(dealt: DataFrame, percent: int) -> DataFrame:
    """(x, y, salt): pairs of others and minor nodes of the same block that may link; dealt is sorted by its blocks (y, salt).

    A minor node and another one differ by as many parities at least as their numbers of
    parities turned against the pivot do.  So with the others sorted by ``least``, those
    that a minor node may link with are among the first, up to its ``most``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ("y", "salt")):
            c = {k: table.column(k).to_numpy() for k in ("y", "salt", "x", "comp", "n", "s", "turned", "edge")}
            minor, main = (table.column(k).to_numpy().astype(bool) for k in ("minor", "in_main"))
            sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SKETCH_WORDS).view(np.uint64)
            new = np.ones(len(minor), bool)
            new[1:] = (c["y"][1:] != c["y"][:-1]) | (c["salt"][1:] != c["salt"][:-1])
            group = np.cumsum(new)
            order = np.lexsort((minor, c["edge"], group))
            others, small = order[~minor[order]], order[minor[order]]
            first = np.searchsorted(group[others], group[small])
            count = np.cumsum(~minor[order])[minor[order]] - first
            ends = np.cumsum(count)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                at = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
                of = np.searchsorted(ends, at, "right")
                x, y = others[first[of] + at - (ends - count)[of]], small[of]
                n, s = c["n"], c["s"]
                differ = (100 - percent) * (n[x] + n[y]) // (100 + percent) - (n - s)[x] - (n - s)[y]
                use = (c["comp"][x] != c["comp"][y]) & (main[x] | (c["x"][x] < c["x"][y])) & (np.abs(c["turned"][x] - c["turned"][y]) <= differ)
                use &= (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((100 + percent) * np.minimum(s[x], s[y]) >= percent * (n[x] + n[y]))
                x, y, differ = x[use], y[use], differ[use]
                use = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= differ
                if use.any():
                    yield pa.RecordBatch.from_pydict({"x": pa.array(c["x"][x[use]]), "y": pa.array(c["x"][y[use]]), "salt": pa.array(c["salt"][x[use]])})

    return dealt.mapInArrow(run, "x bigint, y bigint, salt bigint")


def _joining_links(scratch: Scratch, index: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links, not all of them, that join what all links of index, which has (key, node, s, n), would."""
    pivots = index.groupBy("key").agg(F.max(F.struct((F.col("s") * 1000 / F.col("n")).cast("int").alias("share"), "n", "node", "s")).alias("p"), F.count("*").alias("m")).filter("m > 1")
    pivots = scratch.write(pivots.select("key", "m", F.col("p.node").alias("y"), F.col("p.n").alias("pn"), F.col("p.s").alias("ps")))
    entries = pivots.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    placed = join_hot(index, pivots.withColumn("rows", F.col("m")), ["key"], "rows", entries).filter("node <> y").filter((F.col("m") > 2) | _fits(percent))
    pairs = scratch.write(placed.groupBy(F.col("node").alias("x"), "y").agg(F.max("m").alias("m")))
    x = nodes.select(F.col("node").alias("x"), "n", "s", "sketch")
    y = nodes.select(F.col("node").alias("y"), F.col("n").alias("pn"), F.col("s").alias("ps"), F.col("sketch").alias("psketch"))
    loads = pairs.groupBy("y").agg(F.count("*").alias("load"))
    met = join_hot(pairs.join(x, "x"), y.join(loads, "y"), ["y"], "load", pairs.count())
    met = met.withColumn("turned", _turned())
    known = scratch.write(met.select("x", "y", "n", "s", "sketch", "turned", _may_link(percent).alias("likely"), F.pmod(F.xxhash64("x"), _salts(F.col("m"))).alias("salt")))
    links = scratch.write(compared(scratch.write(known.filter("likely").select("x", "y", "salt")), sets).filter(_similar(percent)).select("x", "y"))

    # what a pivot has not joined: nodes outside its largest component, with the others of another one
    comps = components(links, scratch)
    known = known.join(comps.select(F.col("node").alias("x"), F.col("comp").alias("found")), "x", "left")
    # of a link, (100 + percent) * all that differs <= (100 - percent) * (n + n of the other), with what belongs to either on its side
    least = F.expr(f"{100 + percent} * (n - s - turned) - {100 - percent} * n")
    most = F.expr(f"{100 - percent} * n - {100 + percent} * (n - s + turned)")
    known = scratch.write(known.select("x", "y", "n", "s", "turned", "sketch", F.coalesce("found", "x").alias("comp"), least.alias("least"), most.alias("most")))
    parts = known.groupBy("y", "comp").agg(F.count("*").alias("part"), F.min("least").alias("least"))
    mixed = parts.groupBy("y").agg(F.max(F.struct("part", "comp")).alias("main"), F.sum("part").alias("m"), F.count("*").alias("parts"), F.min("least").alias("nearest")).filter("parts > 1")
    mixed = mixed.select("y", F.col("main.comp").alias("main"), "m", "nearest", _salts(F.col("m")).alias("blocks"))
    known = scratch.write(join_hot(known, mixed, ["y"], "m", known.count()).withColumn("in_main", F.expr("comp = main")))
    columns = ["y", "salt", "x", "comp", "in_main", "n", "s", "turned", "sketch"]
    others = known.withColumn("salt", F.pmod(F.xxhash64("x"), "blocks")).select(*columns, F.col("least").alias("edge"), F.lit(False).alias("minor"))
    minor = known.filter("NOT in_main AND most >= nearest").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = others.union(minor.select(*columns, F.col("most").alias("edge"), F.lit(True).alias("minor")))
    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    more = scratch.write(_pairs_of_blocks(dealt.repartition(tasks, "y", "salt").sortWithinPartitions("y", "salt"), percent).distinct())
    return links.union(scratch.write(compared(more, sets).filter(_similar(percent)).select("x", "y").distinct()))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), count_links=False)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
