"""Language model, quality classifier, mixing, sharding, and the pipeline."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from baseloom.llm import lm_score, mixing, quality, registry, sharding
from tests.llm.conftest import opposite_words


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_base_scores(docs_of, clashing):
    rows = [(i, f"The cat sat on the mat {i % 4} Zebra{i}") for i in range(60)] + [(70, None), (71, ""), (72, "é" * 9), (None, "THE cat"), (73, "x " * 5000), (74, "the cat"), (74, "the cat")]
    got = lm_score.lm_score(clashing(docs_of(rows))).collect()
    tokens = {k: (t or "").encode().lower().split() + [None] for k, (_, t) in enumerate(rows)}
    count = collections.Counter(w for k, (i, _) in enumerate(rows) if not held(i) for w in tokens[k])
    total = sum(count.values())
    expected = []
    for k, (i, _) in enumerate(rows):
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in tokens[k])
        expected.append((-1 if i is None else i, held(i), len(tokens[k]), sum(count[w] > 0 for w in tokens[k]), total, round(base, 6)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(expected)
    assert all(r.score <= 0 for r in got)
    assert lm_score.lm_score(docs_of([(1, "a")]).limit(0)).count() == 0
    one = next(i for i in range(100) if held(i))
    assert lm_score.lm_score(docs_of([(one, "a b")])).first().base_score == 0


def brute_scores(rows, min_pairs):
    """The model with exact counts, each quantised to the middle of its power of two."""
    tokens = {k: (t or "").encode().lower().split() + [None] for k, (_, t) in enumerate(rows)}
    train = [k for k, (i, _) in enumerate(rows) if not held(i)]
    words = collections.Counter(w for k in train for w in tokens[k])
    pairs = collections.Counter(p for k in train for p in zip([0, *tokens[k]], tokens[k]))
    about = lambda c: 0 if c == 0 else 1 if c == 1 else 1.5 * 2 ** int(math.log2(c))
    total, kinds = sum(words.values()), len(words)
    out = []
    for k in range(len(rows)):
        score = 0
        for before, word in zip([0, *tokens[k]], tokens[k]):
            seen = pairs[before, word]
            seen = about(seen) if seen >= min_pairs else 0
            prior = len(train) if before == 0 else about(words[before])
            share = min(1, seen / max(prior, seen, 1))
            score += math.log10(lm_score.PAIR_SHARE * share + (1 - lm_score.PAIR_SHARE) * min(1, (about(words[word]) + 1) / (total + kinds + 1)))
        out.append(score)
    return out


@pytest.mark.parametrize("min_pairs", [1, 2])
def test_scores_against_exact_counts(docs_of, min_pairs):
    """The filter's false positives alone set scores apart: few of them, and upward."""
    r = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{k}" for k in r.zipf(1.4, 30) % 900)) for i in range(250)] + [(400, None), (401, "")]
    got = {x.doc_id: x.score for x in lm_score.lm_score(docs_of(rows), min_pairs=min_pairs).collect()}
    expected = brute_scores(rows, min_pairs)
    apart = np.array([got[i] - e for (i, _), e in zip(rows, expected, strict=True)])
    assert np.median(np.abs(apart)) < 0.2 and np.abs(apart).max() < 4 and abs(sum(got.values()) / sum(expected) - 1) < 0.02


def test_words_that_sums_of_powers_confuse(docs_of):
    one, two = opposite_words()
    train, test = [i for i in range(100) if not held(i)], [i for i in range(100, 200) if held(i)]
    got = {x.doc_id: x.n_known for x in lm_score.lm_score(docs_of([(train[0], one), (test[0], two), (test[1], one)])).collect()}
    assert got == {train[0]: 2, test[0]: 1, test[1]: 2}


def test_scores_prefer_what_was_seen(docs_of):
    rows = [(i, "alpha beta gamma delta " * 5) for i in range(40)]
    good, odd = (i for i in range(200, 400) if held(i)), (i for i in range(400, 600) if held(i))
    rows += [(next(good), "alpha beta gamma delta"), (next(odd), "delta gamma beta alpha")]
    got = {r.doc_id: r for r in lm_score.lm_score(docs_of(rows)).collect()}
    a, b = (got[r[0]] for r in rows[-2:])
    assert a.base_score == pytest.approx(b.base_score) and a.score > b.score + 1


def test_filter_levels():
    r = np.random.default_rng(1)
    grams = np.unique(r.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(3))
    level = r.integers(1, 9, len(grams))
    per_slice, slices = 1 << 12, 64
    bits = np.zeros((slices, per_slice), bool)
    for g, top in zip(grams, level, strict=True):
        for q in range(1, top + 1):
            h, step = lm_score.keys_of(np.array([g]), np.array([q], np.uint64))
            for i in range(lm_score.PROBES):
                bits[lm_score.slice_of(np.array([g]), slices)[0], lm_score.position(h, step, i, per_slice)] = True
    f = lm_score.Filter(np.packbits(bits, axis=1, bitorder="little").reshape(-1), slices, 1, 1, 1)
    got = f.levels(grams)
    assert (got >= level).all() and (got == level).mean() > 0.95
    assert (f.levels(r.integers(0, 2**63, 4000).astype(np.uint64)) == 0).mean() > 0.95


def test_filter_in_passes(docs_of):
    """The filter isn't cut to what is broadcast at once: more passes, equal scores; and levels end at the highest one."""
    r = np.random.default_rng(2)
    docs = docs_of([(i, " ".join(f"w{k}" for k in r.zipf(1.3, 40) % 5000)) for i in range(300)] + [(900, None), (901, "")])
    scores = lambda **k: sorted((x.doc_id, x.score, x.base_score) for x in lm_score.lm_score(docs, **k).collect())
    assert np.allclose(scores(max_filter_bits=1 << 15), scores(), atol=1e-9)
    full = np.full(64 * 8, 255, np.uint8)
    assert set(lm_score.Filter(full, 64, 1, 1, 1, top=5).levels(r.integers(0, 2**63, 50).astype(np.uint64)).tolist()) == {5}


def _junk(i):
    return ["spam " * (20 + i % 30), " | ".join(f"w{i}{k}" for k in range(30)), "".join(f"wo{k}$$$ rd%%% " for k in range(20 + i % 9)), "LOUD!! WORDS!! " * (9 + i % 7)][i % 4]


def test_quality(spark, docs_of, clashing):
    import random

    r = random.Random(3)
    words = ["river", "stone", "a", "the", "of", "window", "and", "light", "was", "over"]
    rows = [(i, _junk(i) if i % 5 == 0 else ". ".join(" ".join(r.choices(words, k=9)).capitalize() for _ in range(r.randint(2, 12)))) for i in range(900)]
    docs = docs_of([*rows, (2000, None), (2001, ""), (None, "a text")])
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(900)] + [(None, 1, 0), (1, None, 0), (3, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score(clashing(docs), model).select("doc_id", "score", "text", "key").collect()
    assert len(out) == 903 and all(0 <= x.score <= 1 for x in out)
    test = [(x.score >= 0.3) == (x.doc_id % 5 > 0) for x in out if x.doc_id is not None and x.doc_id < 900 and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert len(test) > 100 and sum(test) / len(test) > 0.97
    none = quality.train(docs, labels.limit(0))
    assert {x.score for x in quality.score(docs.select("text"), none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id % 5 = 0").count() < 20


def brute_targets(sizes):
    names = sorted([k for k in sizes if k is not None]) + [k for k in sizes if k is None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[k] for k in stopped)
        share = sum(weight[k] for k in names if k not in stopped)
        out = {k: 3 * sizes[k] if k in stopped else left * weight[k] / share for k in names}
        more = {k for k in names if k not in stopped and out[k] > 3 * sizes[k]}
        if not more:
            return out
        stopped |= more


@pytest.mark.parametrize("spread", [{"a": 900, "b": 50, "c": 5, None: 300}, {"a": 10, "b": 900, "c": 900}, {"z": 40}, {"a": 1, "b": 1, "c": 400, "d": 3, "e": 700}])
def test_mixing(docs_of, spread):
    rows, n = [], 0
    for source, words in spread.items():
        while words > 0:
            k = min(words, 1 + n % 9)
            rows.append((n, "w " * k, source))
            words, n = words - k, n + 1
    rows += [(n, None, "a" if "a" in spread else "z"), (n + 1, " ", "a" if "a" in spread else "z")]
    docs = docs_of(rows)
    thin = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    got = mixing.queue(thin).collect()
    goal = brute_targets(spread)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == spread[r.source] and r.copies <= 3
        taken[r.source] += r.size * r.copies
    assert len(got) == len(rows) and all(abs(taken[k] - goal[k]) <= 9 for k in spread)
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in mixing.queue(thin.repartition(5)).collect())


def test_mix_rows(docs_of, clashing):
    docs = clashing(docs_of([(i, "w " * (1 + i % 5), f"s{i % 4}") for i in range(80)] + [(90, None, None), (None, "x y", None), (5, "again", "s1"), (5, "again", "s1")]))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and max(c for _, c in collections.Counter(r.doc_id for r in out.collect() if r.doc_id not in (5, None)).items()) <= 3
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_is_in_order_and_within_its_budget(docs_of):
    """Finish times rise, all words are spent but for half a document, and equal rows are taken as the queue says."""
    import random

    r = random.Random(4)
    rows = [(i, "w " * r.randint(1, 30), r.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(7, "same row here", "b")] * 5
    docs = docs_of(rows)
    out = [(x.doc_id, x.source, len(x.text.split())) for x in mixing.mix(docs).collect()]
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(n for *_, n in out) - total) <= 30
    thin = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    queued = mixing.queue(thin).collect()
    taken = collections.Counter()
    for x in queued:
        taken[x.doc_id, x.source, x.size] += x.copies
    assert collections.Counter(out) == +taken
    spent, finish = collections.Counter(), {x.source: x.target for x in queued}
    last = 0
    for _, source, n in out:  # served in turn: no source runs ahead of the others by more than a document
        spent[source] += n
        now = spent[source] / finish[source]
        assert now >= last - 35 / finish[source] - 1e-9
        last = max(last, now)


def test_quality_of_odd_rows(spark, docs_of, clashing):
    """Repeated rows, null and very long texts, empty tables and clashing names."""
    rows = [(i, _junk(i) if i % 5 == 0 else "a plain text of words. " * (1 + i % 7)) for i in range(300)]
    rows += rows[:40] + [(400, "word " * 200_000), (401, None), (None, None), (401, "")]
    docs = clashing(docs_of(rows)).withColumn("body", F.lit("b"))
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(300)] * 2, "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    again = quality.train(docs.repartition(7), labels)
    split = quality.train(docs, labels, group_rows=90)
    assert np.allclose(model.weight, again.weight, atol=1e-5) and model.prior == again.prior
    apart = lambda m: [x.p >= 0.3 for x in quality.score(docs, m, score_col="p").orderBy("doc_id").collect() if x.doc_id is not None and x.doc_id < 300]
    assert sum(a != b for a, b in zip(apart(model), apart(split), strict=True)) < 15
    out = quality.score(docs, model, score_col="p").collect()
    assert len(out) == len(rows) and len({x.p for x in out if x.doc_id == 5}) == 1 and all(0 <= x.p <= 1 for x in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0


def test_lookup_table():
    table = sharding.lookup_table([f"s{i}" for i in range(7)], 1009)
    sizes = collections.Counter(table)
    assert set(table) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    # the rule, played out with sets
    free, claimed = set(range(1009)), {}
    orders = []
    for name in (f"s{i}" for i in range(7)):
        start, step = (sharding._hash(name, salt) for salt in ("offset", "step"))
        orders.append([(start % 1009 + k * (step % 1008 + 1)) % 1009 for k in range(1009)])
    turn = 0
    while free:
        mine = next(s for s in orders[turn % 7] if s in free)
        claimed[mine] = turn % 7
        free.remove(mine)
        turn += 1
    assert table == [claimed[s] for s in range(1009)]
    assert sharding.slots_for(64) == 65537 and sharding.slots_for(1000) == 128021
    fewer = sharding.lookup_table([f"s{i}" for i in range(6)], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.1 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)


def test_placement(docs_of, clashing):
    import hashlib

    rows = [(i, "t") for i in range(300)] + [(None, None), (7, "again")]
    docs = clashing(docs_of(rows))
    got = sharding.place(docs, shards=5, slots=1009).collect()
    table = sharding.lookup_table([f"shard-{i:05d}" for i in range(5)], 1009)
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, f"shard-{table[slot]:05d}")
    assert len(got) == 302 and sharding.place(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage on what its predecessor left: junk, copies and leaks go, shards are full."""
    import random

    r = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in ("ri", "sto", "lan", "me") for b in ("ver", "ne", "ta", "ro") for c in ("", "s", "d", "l", "n")]
    text = lambda: ". ".join(" ".join(r.choices(vocabulary, k=9)).capitalize() for _ in range(r.randint(3, 9)))
    items = [(i, " ".join(r.choices(vocabulary, k=20))) for i in range(5)]
    rows = [(i, _junk(i) if i % 5 == 0 else text(), "en", f"s{i % 3}", 1) for i in range(400)]
    rows += [(1000 + i, rows[i * 5 + 1][1], "en", "s0", 1) for i in range(20)]
    rows += [(1100 + i, f"{text()}. {items[i][1]}. {text()}", "en", "s1", 1) for i in range(5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    ids = {x.doc_id for x in out}
    assert not ids & {1000 + i for i in range(20)} and not ids & {1100 + i for i in range(5)}
    assert sum(i % 5 == 0 for i in ids if i < 400) <= 8 and len(ids) > 150
    assert len({x.shard for x in out}) > 20
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and empty texts, repeated rows, a null id and source, columns more, and empty tables."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, hits string, slot int"
    words = "the quick brown fox jumps over a lazy dog near the old river bank today".split()
    rows = [(i, " ".join(words[(i + k * (i % 3 + 1)) % 15] + str(i % 11) for k in range(30)), "en", None if i % 4 else "s", 1, "h", 3) for i in range(60)]
    rows += [(None, "a text without an id", "en", "s", 1, None, None), (70, None, None, None, None, None, None), (71, "", "en", "s", 0, "h", 1), (72, "z " * 100_000, "en", "s", 1, "h", 1)] + rows[:5]
    for name, some in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(60)][: len(some)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (2, ""), (3, "no such passage anywhere in it")][: len(some)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        out = corpus_pipeline.run(spark, d)
        assert "shard" in out.columns and (out.count() > 0) == bool(some)
        assert out.groupBy("doc_id").count().filter("count > 3").count() == 0


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names)
