"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to whole logarithms.  A gram of level q is
put into a Bloom filter q times, as (gram, 1) to (gram, q); its level is found again by
probing (gram, 1), (gram, 2), ... until a probe misses or the highest level of all is
reached.  The filter is cut in slices by gram, built slice by slice where the counts
are, and written; its size grows with the counted grams, so that false positives don't.
It is broadcast in passes over the documents, as many slices at once as ``PASS_BITS``
allows; between passes a document carries the levels found so far, a byte for each.

The exact base score needs exact counts.  Words above one in ``HOT_SHARE`` of all
tokens, of which there can be no more than that, are broadcast; the others of a
document are shuffled to the counts, packed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.llm import _vector as V
from baseloom.llm._scratch import Scratch
from baseloom.llm._windows import Entries, keyed, partitions

#: Share of the pair estimate in a smoothed probability; the rest is the word estimate.
PAIR_SHARE = 0.3
#: Pairs seen less often aren't stored: they score by their words, as unseen ones do.  By default all are stored.
MIN_PAIRS = 1
#: Bits of the filter that are broadcast at once (64 MB).  The whole filter has no bound.
PASS_BITS = 1 << 29
BITS_A_KEY = 12
PROBES = 3
HOT_SHARE = 20_000
TOKENS = 1_000_000
END, START = np.uint64(0xE0D1E0D1E0D1E0D1), np.uint64(0x57A2757A2757A275)


def held_out(ident) -> F.Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(block: V.Block) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): of each text its words in lower case and an end."""
    low = V.LOWER[block.data]
    starts, ends, first = V.split_words(V.Block(block.rows, low, block.offs))
    words = V.spans(low, starts, ends)
    texts = np.arange(len(first))
    out = np.empty(len(words) + len(block), np.uint64)
    last = first[1:] + texts[:-1]
    out[last] = END
    is_word = np.ones(len(out), bool)
    is_word[last] = False
    out[is_word] = words
    return out, first + texts


def pairs(toks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the token before each, the hash of both)."""
    before = np.empty_like(toks)
    before[1:] = toks[:-1]
    before[first[:-1]] = START
    return before, V.mix(V.join(before, toks))


def level(count: np.ndarray) -> np.ndarray:
    return np.log2(count).astype(np.int64) + 1


def expected(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    return np.where(levels <= 1, levels, 1.5 * 2.0 ** (levels - 1))


@dataclass
class Filter:
    bits: np.ndarray
    slices: int
    total: int
    kinds: int
    contexts: int
    #: The slices that bits holds; all if None.
    held: range | None = None
    #: The highest level in the filter.
    top: int = 64

    @property
    def per_slice(self) -> int:
        return len(self.bits) * 8 // (self.slices if self.held is None else len(self.held))

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """0 for grams of slices that aren't held."""
        out, part = np.zeros(len(grams), np.int64), slice_of(grams, self.slices).astype(np.int64)
        held = self.held or range(self.slices)
        alive = np.flatnonzero((part >= held.start) & (part < held.stop))
        part = (part - held.start) * self.per_slice
        q = 1
        while len(alive) and q <= self.top:
            h, step = keys_of(grams[alive], np.full(len(alive), q, np.uint64))
            for i in range(PROBES):
                at = position(h, step, i, self.per_slice) + part[alive]
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                alive, h, step = alive[hit], h[hit], step[hit]
            out[alive] = q
            q += 1
        return out

    def levels_of(self, toks: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels of each word and of each pair."""
        out = []
        for grams in (toks, both):
            kinds, at = np.unique(grams, return_inverse=True)
            out.append(self.levels(kinds)[at].astype(np.uint8))
        return tuple(out)

    def log_probability(self, first: np.ndarray, words: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Of each token, from the levels of words and pairs."""
        count, seen = expected(words.astype(np.int64)), expected(both.astype(np.int64))
        lone = np.minimum(1.0, (count + 1) / (self.total + self.kinds + 1))
        prior = np.empty(len(words))
        prior[1:] = count[:-1]
        prior[first[:-1]] = self.contexts  # documents start as often as there are documents
        pair = np.minimum(1.0, seen / np.maximum(prior, np.maximum(seen, 1)))
        return np.log10(PAIR_SHARE * pair + (1 - PAIR_SHARE) * lone)


def slice_of(grams: np.ndarray, slices: int) -> np.ndarray:
    return grams >> np.uint64(64 - (slices - 1).bit_length())


def keys_of(grams: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, step) of the probes for (gram, q)."""
    h = V.mix(grams + q * np.uint64(V.BASE_1))
    return h, V.mix(h) | np.uint64(1)


def position(h: np.ndarray, step: np.ndarray, i: int, per_slice: int) -> np.ndarray:
    return ((h + np.uint64(i) * step) & np.uint64(per_slice - 1)).astype(np.int64)


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(h, return_inverse=True)
    return kinds, np.bincount(at, c, len(kinds)).astype(np.int64)


def counted(train: DataFrame, slices: int, tasks: int) -> DataFrame:
    """A row for each slice: exact counts of words (wh, wc) and of pairs (ph, pc), packed; and texts, their number."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Entries(("t", "p"))

        def flush() -> pa.RecordBatch:
            at = held.take()
            columns = {}
            for name, h in (("w", at["t"]), ("p", at["p"])):
                kinds, count = np.unique(h, return_counts=True)
                columns |= V.packed(slice_of(kinds, slices).astype(np.int64), slices, {f"{name}h": kinds, f"{name}c": count.astype(np.int64)})
            return pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(slices, dtype=np.int32))} | columns)

        for batch in batches:
            for block in V.blocks(batch):
                toks, first = tokens(block)
                held.add(t=toks, p=pairs(toks, first)[1])
                if held.size >= TOKENS:
                    yield flush()
        if held.size:
            yield flush()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                held.setdefault(k, []).append(batch.slice(i, 1))
        while held:
            k, rows = held.popitem()
            out = {"slice": pa.array([k], pa.int32())}
            for j, name in ((1, "w"), (3, "p")):
                h, c = (np.concatenate([V.unpacked(r.column(j + d), t) for r in rows]) for d, t in ((0, np.uint64), (1, np.int64)))
                h, c = _summed(h, c)
                out |= {f"{name}h": pa.array([h.tobytes()], pa.binary()), f"{name}c": pa.array([c.tobytes()], pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    kind = "slice int, wh binary, wc binary, ph binary, pc binary"
    return train.mapInArrow(send, kind).repartition(tasks, "slice").mapInArrow(receive, kind)


def _summary(counts: DataFrame, min_pairs: int) -> dict[str, int]:
    """Over all slices: tokens, kinds of words, texts, keys that the filter takes, and the highest level."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = kinds = ends = keys = top = 0
        for batch in batches:
            for i in range(batch.num_rows):
                wh, wc, _, pc = (V.unpacked(batch.column(j).slice(i, 1), t) for j, t in ((1, np.uint64), (2, np.int64), (3, np.uint64), (4, np.int64)))
                total, kinds = total + int(wc.sum()), kinds + len(wc)
                ends += int(wc[wh == END].sum())
                levels = [level(wc), level(pc[pc >= min_pairs])]
                keys += sum(int(x.sum()) for x in levels)
                top = max(top, *(int(x.max(initial=0)) for x in levels))
        yield pa.RecordBatch.from_pydict({"total": [total], "kinds": [kinds], "ends": [ends], "keys": [keys], "top": [top]})

    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("total", "kinds", "ends", "keys")]
    row = counts.mapInArrow(one, "total bigint, kinds bigint, ends bigint, keys bigint, top bigint").agg(*sums, F.coalesce(F.max("top"), F.lit(0)).alias("top")).first()
    return row.asDict()


def bits_of_slice(slices: int, keys: int) -> int:
    """A power of two, with BITS_A_KEY for each key at least."""
    return max(64, (1 << max(16, (BITS_A_KEY * keys).bit_length())) // slices)


def filter_slices(counts: DataFrame, per_slice: int, min_pairs: int) -> DataFrame:
    """(slice, bits): the whole filter."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                found = np.zeros(per_slice, bool)
                for j, least in ((1, 1), (3, min_pairs)):
                    h, c = V.unpacked(batch.column(j).slice(i, 1), np.uint64), V.unpacked(batch.column(j + 1).slice(i, 1), np.int64)
                    h, c = h[c >= least], c[c >= least]
                    top = level(c)
                    grams, q = np.repeat(h, top), np.arange(top.sum()) - np.repeat(np.cumsum(top) - top, top) + 1
                    h, step = keys_of(grams, q.astype(np.uint64))
                    for probe in range(PROBES):
                        found[position(h, step, probe, per_slice)] = True
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())})

    return counts.mapInArrow(build, "slice int, bits binary")


def held_filter(table: DataFrame, held: range, slices: int, per_slice: int, known: dict[str, int]) -> Filter:
    """Some slices of the filter, in memory."""
    out = np.zeros((len(held), per_slice // 8), np.uint8)
    for row in table.filter(F.col("slice").between(held.start, held.stop - 1)).toLocalIterator():
        out[row["slice"] - held.start] = np.frombuffer(row["bits"], np.uint8)
    return Filter(out.reshape(-1), slices, known["total"], known["kinds"], known["ends"], held, known["top"])


def hot_words(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words, and their counts, that make up one in HOT_SHARE of all tokens each: HOT_SHARE of them at most."""
    least = max(1, -(-total // HOT_SHARE))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, c = V.unpacked(batch.column(1).slice(i, 1), np.uint64), V.unpacked(batch.column(2).slice(i, 1), np.int64)
                use = c >= least
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[use].view(np.int64)), "c": pa.array(c[use])})

    got = counts.mapInArrow(pick, "h bigint, c bigint").toPandas()
    h, c = got["h"].to_numpy(np.int64).view(np.uint64), got["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _found(words: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The words' counts in a sorted table; 0 where it hasn't them."""
    h, c = table
    if not len(h):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(h, words), len(h) - 1)
    return np.where(h[at] == words, c[at], 0)


def lm_score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_filter_bits: int = PASS_BITS, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that aren't held out.  Null and empty texts are an end alone.
    A null id is treated as the empty string in the choice of held-out rows.  Without
    training rows no token is known and both scores rest on smoothing alone.  Rows that
    share id and text score alike.  Other columns are ignored.  Words are told apart by
    64 bits of hash.  max_filter_bits bounds what is broadcast at once, not the filter:
    with less there are more passes and the same scores.  Pairs seen less than min_pairs
    times score as unseen ones do.
    """
    spark = docs.sparkSession
    scratch, rows = Scratch(spark), keyed(docs, text_col, id_col)
    texts = rows.select("id", "rk", "text")
    tasks = partitions(texts)
    slices = 1 << max(8, (4 * tasks - 1).bit_length())
    counts = scratch.write(counted(rows.filter(~held_out(F.col("doc_id"))).select("text"), slices, tasks))
    known = _summary(counts, min_pairs)
    total, kinds = known["total"], known["kinds"]
    per_slice = bits_of_slice(slices, known["keys"])
    table = scratch.write(filter_slices(counts, per_slice, min_pairs))
    at_once = max(1, max_filter_bits // per_slice)
    passes = [range(k, min(slices, k + at_once)) for k in range(0, slices, at_once)]
    hot = spark.sparkContext.broadcast(hot_words(counts, total))
    homes = 2 * tasks

    def probed(model, batch: pa.RecordBatch) -> Iterator[tuple[V.Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, tokens, first, levels of words, levels of pairs) with what earlier passes found."""
        earlier, lo = [V.unpacked(batch.column(j), np.uint8) for j in (4, 5)] if batch.num_columns > 4 else None, 0
        for block in V.blocks(batch):
            toks, first = tokens(block)
            words, both = model.value.levels_of(toks, pairs(toks, first)[1])
            if earlier:  # a gram is of one slice, so of one pass
                words, both = (x + e[lo : lo + len(toks)] for x, e in zip((words, both), earlier, strict=True))
                lo += len(toks)
            yield block, toks, first, words, both

    source, columns = rows.select("id", "rk", "doc_id", "text"), "id bigint, rk bigint, doc_id bigint"
    for held in passes[:-1]:
        part = spark.sparkContext.broadcast(held_filter(table, held, slices, per_slice, known))

        def probe(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(np.diff(first), words, both) for _, _, first, words, both in probed(part, batch)]
                if got:
                    sizes, words, both = (np.concatenate(x) for x in zip(*got, strict=True))
                    cuts = np.concatenate([[0], np.cumsum(sizes)])
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], V.binary(words, cuts), V.binary(both, cuts)], names=["id", "rk", "doc_id", "text", "words", "pairs"])

        carried = scratch.write(source.mapInArrow(probe, f"{columns}, text string, words binary, pairs binary"))
        if held.start:
            scratch.drop(source)
        source = carried
        part.destroy()
    model = spark.sparkContext.broadcast(held_filter(table, passes[-1], slices, per_slice, known))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rks = V.idents(batch)
            parts = []
            for block, toks, first, words, both in probed(model, batch):
                n = len(block)
                doc = np.repeat(np.arange(n), np.diff(first))
                count = _found(toks, hot.value)
                parts.append((np.diff(first), np.bincount(doc[count > 0], minlength=n), np.bincount(doc, np.where(count > 0, np.log10(count + 1.0), 0), n), np.bincount(doc, model.value.log_probability(first, words, both), n)))
            got = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "rk": pa.array(rks), "doc_id": batch.column(2), "n_tokens": pa.array(got[0].astype(np.int64)), "hot_known": pa.array(got[1].astype(np.int64)), "hot_score": pa.array(got[2].astype(float)), "score": pa.array(got[3].astype(float))})

    scored = scratch.write(source.mapInArrow(local, f"{columns}, n_tokens bigint, hot_known bigint, hot_score double, score double"))
    if len(passes) > 1:
        scratch.drop(source)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Entries(("h", "id", "rk"))

        def flush() -> pa.RecordBatch:
            at = held.take()
            order, starts = V.groups([at["h"], at["rk"], at["id"]])
            n = np.diff(np.append(starts, len(order))).astype(np.int32)
            pick = order[np.sort(starts)]
            columns = {"h": at["h"][pick], "id": at["id"][pick], "rk": at["rk"][pick], "n": n}
            by_doc = np.lexsort((columns["rk"], columns["id"]))
            columns = {k: v[by_doc] for k, v in columns.items()}
            out = V.packed(slice_of(columns["h"], slices).astype(np.int64), slices, columns)
            return pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(slices, dtype=np.int32))} | out)

        for batch in batches:
            ids, rks = V.idents(batch)
            for block in V.blocks(batch):
                toks, first = tokens(block)
                doc = np.repeat(np.arange(len(block)), np.diff(first))
                use = _found(toks, hot.value) == 0
                held.add(h=toks[use], id=ids[block.rows][doc[use]], rk=rks[block.rows][doc[use]])
                if held.size >= TOKENS:
                    yield flush()
        if held.size:
            yield flush()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                if batch.column(5).is_valid()[i].as_py():
                    table[k] = tuple(V.unpacked(batch.column(j).slice(i, 1), t) for j, t in ((5, np.uint64), (6, np.int64)))
                else:
                    held.setdefault(k, []).append(batch.slice(i, 1))
        parts: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            ids, rks, known, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order, starts = V.groups([rks, ids])
            columns = {"id": ids[order[starts]], "rk": rks[order[starts]], "known": np.add.reduceat(known[order], starts), "score": np.add.reduceat(score[order], starts)}
            out = V.packed((columns["rk"].view(np.uint64) % np.uint64(homes)).astype(np.int64), homes, columns)
            return pa.RecordBatch.from_pydict({"home": pa.array(np.arange(homes, dtype=np.int32))} | out)

        size = 0
        while held:
            k, rows_ = held.popitem()
            h, ids, rks, n = (np.concatenate([V.unpacked(r.column(j), t) for r in rows_]) for j, t in ((1, np.uint64), (2, np.int64), (3, np.int64), (4, np.int32)))
            count = _found(h, table.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64))))
            use = count > 0
            parts.append((ids[use], rks[use], n[use].astype(np.int64), n[use] * np.log10(count[use] + 1.0)))
            size += int(use.sum())
            if size >= TOKENS:
                yield flush()
                size = 0
        if parts and size:
            yield flush()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                held.setdefault(k, []).append(batch.slice(i, 1))
        while held:
            _, rows_ = held.popitem()
            ids, rks, known, score = (np.concatenate([V.unpacked(r.column(j), t) for r in rows_]) for j, t in ((1, np.int64), (2, np.int64), (3, np.int64), (4, np.float64)))
            if not len(ids):
                continue
            order = np.lexsort((score, rks, ids))  # in a fixed order, for equal sums
            i, r = ids[order], rks[order]
            starts = np.concatenate([[0], np.flatnonzero((i[1:] != i[:-1]) | (r[1:] != r[:-1])) + 1])
            yield pa.RecordBatch.from_pydict({"id": pa.array(i[starts]), "rk": pa.array(r[starts]), "rare_known": pa.array(np.add.reduceat(known[order], starts)), "rare_score": pa.array(np.add.reduceat(score[order], starts))})

    asked = texts.mapInArrow(rare, "slice int, h binary, id binary, rk binary, n binary").withColumns({"wh": F.lit(None).cast("binary"), "wc": F.lit(None).cast("binary")})
    empty = F.lit(None).cast("binary")
    told = counts.select("slice", *(empty.alias(k) for k in ("h", "id", "rk", "n")), "wh", "wc")
    answers = asked.unionByName(told).repartition(tasks, "slice").mapInArrow(look_up, "home int, id binary, rk binary, known binary, score binary")
    sums = answers.repartition(tasks, "home").mapInArrow(summed, "id bigint, rk bigint, rare_known bigint, rare_score double")
    sums = scratch.write(sums).groupBy("id", "rk").agg(F.max("rare_known").alias("rare_known"), F.max("rare_score").alias("rare_score"))
    out = scored.join(sums, ["id", "rk"], "left")
    smooth = float(np.log10(total + kinds + 1))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0)) - F.col("n_tokens") * smooth).alias("base_score"),
        "score",
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
