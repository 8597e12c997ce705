"""The Jaccard join against all pairs, and decontamination against plain edit distance."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from baseloom.llm import components, decontam, jaccard_join
from baseloom.llm._scratch import Scratch
from tests.llm.conftest import opposite_words


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingle_set(text, size):
    words = lower(text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, percent=75, size=5):
    ids = [-(2**63) if i is None else i for i, _ in rows]
    sets = [shingle_set(t, size) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * len(sets[a] | sets[b]):
                comp[root(a)] = root(b)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[root(i)]) for i in range(len(rows)))


def got(df):
    null = -(2**63)
    return sorted((null if r.doc_id is None else r.doc_id, r.n_shingles, null if r.component_id is None else r.component_id) for r in df.collect())


def near_copies(seed, n=70, bases=5, words=90, edits=12, vocabulary=400):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, vocabulary)}" for _ in range(r.randint(3, words))] for _ in range(bases)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, edits)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 2)] = [f"w{r.randint(0, vocabulary)}"] * r.randint(0, 2)
            w = w or ["w"]
        rows.append((i * 13 % 997, " ".join(w)))
    return rows


ODD = [(800, None), (801, ""), (802, " \n"), (803, "one two"), (804, "One TWO"), (805, "one two three"), (None, "one two three"), (806, "a b c d e"), (807, "x" * 50_000)]


@pytest.mark.parametrize("seed, percent, frequent", [(1, 75, 48), (2, 75, 3), (3, 60, 2), (4, 90, 5), (5, 100, 2)])
def test_against_all_pairs(docs_of, clashing, seed, percent, frequent):
    rows = near_copies(seed) + (ODD if seed < 3 else [])
    df = docs_of(rows)
    out = jaccard_join.jaccard_join(clashing(df) if seed == 1 else df, percent, frequent=frequent)
    assert got(out) == brute(rows, percent)


def test_words_that_sums_of_powers_confuse(docs_of):
    one, two = opposite_words()
    rows = [(1, one), (2, two), (3, f"{one} b c d e f"), (4, f"{two} b c d e f"), (5, one)]
    assert got(jaccard_join.jaccard_join(docs_of(rows))) == brute(rows)


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_sketches_never_rule_out_a_link(percent):
    """Similar sets differ in no more parities than shingles."""
    r = np.random.default_rng(percent)
    for _ in range(200):
        n = int(r.integers(5, 3000))
        x = np.unique(r.integers(1, 1 << 60, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) > r.random() * 0.4], r.integers(1, 1 << 60, int(n * r.random() * 0.3)).astype(np.uint64)]))
        a, b = (jaccard_join.sketches(np.zeros(len(v), np.int64), v, 1) for v in (x, y))
        apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y))
        assert int(np.bitwise_count(a ^ b).sum()) <= apart and (int(np.bitwise_count(a ^ b).sum()) - apart) % 2 == 0


def test_short_documents(docs_of):
    """Small sets, all of frequent shingles."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choices("abcd", k=r.randint(1, 14)))) for i in range(120)]
    assert got(jaccard_join.jaccard_join(docs_of(rows, 5), 60, size=2, frequent=1)) == brute(rows, 60, 2)
    assert got(jaccard_join.jaccard_join(docs_of(rows, 5), 75, size=1, frequent=1)) == brute(rows, 75, 1)


def test_long_documents_of_frequent_shingles(docs_of):
    """Extended prefixes over several subclasses and sizes next to a power of two."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(24):
        w = list(base[: r.choice([120, 128, 135, 250, 256, 262])])
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    assert got(jaccard_join.jaccard_join(docs_of(rows), 75, size=2, frequent=1)) == brute(rows, 75, 2)


def test_any_shared_key_of_a_linked_pair():
    """What the prefixes promise, straight from index_keys: linked sets share a key, whatever is frequent."""
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(2, 200))
        x = r.choice(1 << 40, n, replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        y = np.unique(np.concatenate([x[r.random(n) > r.random() * 0.25], r.integers(0, 1 << 60, int(r.integers(0, n // 8 + 1))).astype(np.uint64)]))
        x = np.unique(x)
        k = len(np.intersect1d(x, y))
        if 4 * k < 3 * (len(x) + len(y) - k) or len(np.union1d(x, y)) == k:
            continue
        both = np.concatenate([x, y])
        often = np.unique(both[r.random(len(both)) < r.random()])
        classes = jaccard_join.Classes(64, np.full(64 * 8, 255, np.uint8), np.unique(often >> np.uint64(32 - 6)))
        a, *_ = jaccard_join.index_keys(x, np.array([0, len(x)]), classes, 75)
        b, *_ = jaccard_join.index_keys(y, np.array([0, len(y)]), classes, 75)
        assert len(np.intersect1d(a, b))


@pytest.mark.parametrize("percent, frequent, block", [(75, 48, 256), (60, 3, 4)])
def test_all_links_are_counted(docs_of, percent, frequent, block):
    """Also between sets that other links join already, and across the blocks of a key."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(25)] + [(100 + i, " ".join([f"y{i}", *base])) for i in range(5)] + [(200 + i, t) for i, (_, t) in enumerate(near_copies(9, 40))]
    rows += [(300, rows[0][1]), (301, None), (302, "one two")]
    r.shuffle(rows)
    sets = {i: shingle_set(t, 5) for i, t in rows}
    kinds = set(sets.values()) - {frozenset()}
    links = {i: sum(o != s and 100 * len(o & s) >= percent * len(o | s) for o in kinds) for i, s in sets.items()}
    out = jaccard_join.jaccard_join(docs_of(rows), percent, frequent=frequent, block=block)
    assert {x.doc_id: x.n_links for x in out.collect()} == links and links[1] >= 24
    assert got(out) == brute(rows, percent)
    thin = jaccard_join.jaccard_join(docs_of(rows), percent, frequent=frequent, count_links=False)
    assert "n_links" not in thin.columns and got(thin) == brute(rows, percent)


@pytest.mark.parametrize("seed, percent, frequent", [(2, 75, 3), (3, 60, 2)])
def test_components_without_links(docs_of, seed, percent, frequent):
    """The rounds of pivots, which op6 and the pipeline take."""
    rows = near_copies(seed) + ODD
    assert got(jaccard_join.jaccard_join(docs_of(rows), percent, frequent=frequent, count_links=False)) == brute(rows, percent)


def cpu_seconds(spark):
    """CPU seconds of the tasks of each stage so far, without those of Python."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.executorCpuTime() / 1e9 for s in (stages.apply(i) for i in range(stages.size()))}


def test_groups_of_near_copies_in_proportion(spark, docs_of):
    """What a pivot doesn't join, a part of thousands of edited texts, isn't held against all others of the group one by one."""
    r = random.Random(12)
    rows = [(0, " ".join(f"w{i}" for i in range(80)))]
    for i in range(1, 4000):
        w = rows[0][1].split()
        for k in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"x{i}-{k}"
        for _ in range(r.choice([0, 0, 1, 2])):
            del w[r.randrange(len(w))]
        rows.append((i, " ".join(w)))
    before = cpu_seconds(spark)
    out = got(jaccard_join.jaccard_join(docs_of(rows), count_links=False))
    most = max(v for k, v in cpu_seconds(spark).items() if k not in before)

    sets = [shingle_set(t, 5) for _, t in rows]
    n, place = np.array([len(x) for x in sets]), {}
    for x in sets:
        for shingle in x:
            place.setdefault(shingle, len(place))
    owner = np.repeat(np.arange(len(sets)), n)
    item = np.array([place[shingle] for x in sets for shingle in x])
    column = np.cumsum(np.bincount(item) > 1) - 1
    shared = np.bincount(item)[item] > 1
    has = np.zeros((len(sets), column[-1] + 1), np.float32)
    has[owner[shared], column[item[shared]]] = 1
    k = (has @ has.T).astype(np.int64)
    links = 100 * k >= 75 * (n[:, None] + n - k)
    np.fill_diagonal(links, True)
    least, old = np.arange(len(sets)), None
    while old is None or (least != old).any():
        old, least = least, np.where(links, least, len(sets)).min(1)
    assert out == sorted(zip(range(len(sets)), n.tolist(), least.tolist(), strict=True))
    assert 1000 < (least != 0).sum() < 3000
    assert most < 6


def test_whole_groups():
    """Groups over several batches, one that ends with its batch, and empty batches."""
    y, salt = [1] * 5 + [2] * 2 + [2] * 3 + [3], [0] * 5 + [0] * 2 + [1] * 3 + [1]
    table = pa.table({"y": y, "salt": salt, "x": list(range(len(y)))})
    for cuts in ([0, 11], [0, 2, 2, 4, 5, 6, 11], [0, 5, 7, 10, 11], list(range(12))):
        batches = [table.slice(a, b - a).combine_chunks().to_batches() or [table.schema.empty_table().combine_chunks()] for a, b in zip(cuts, cuts[1:], strict=False)]
        out = list(jaccard_join._whole_groups((b for bs in batches for b in bs if isinstance(b, pa.RecordBatch)), ("y", "salt")))
        assert [i for t in out for i in t["x"].to_pylist()] == list(range(11))
        keys = [set(zip(t["y"].to_pylist(), t["salt"].to_pylist(), strict=True)) for t in out]
        assert sum(map(len, keys)) == len(set().union(*keys)) == 4


def test_one_of_each_group_stays(docs_of, clashing):
    rows = [*near_copies(1, 30), (500, None), (501, None), (502, "solo words only here now"), (502, "solo words only here now")]
    df = clashing(docs_of(rows))
    out = jaccard_join.near_dedup(df)
    assert out.columns == df.columns
    expected = sorted([i for i, n, c in brute(rows[:30]) if i == c] + [500, 501, 502])
    assert sorted(r.doc_id for r in out.collect()) == expected
    assert jaccard_join.near_dedup(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 200), (150, 120)]
    edges = spark.createDataFrame(chain, "x bigint, y bigint")
    out = {r.node: r.comp for r in components.components(edges, Scratch(spark)).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100, 120: 120, 150: 120, 200: 120}


def plain_distance(item, words):
    """Least edits between item and any run of words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers():
    r = random.Random(2)
    for _ in range(300):
        a = [r.randint(0, 4) for _ in range(r.randint(1, 90))]
        b = [r.randint(0, 4) for _ in range(r.randint(0, 90))]
        assert decontam.distance(np.array(a, np.uint64), np.array(b, np.uint64)) == plain_distance(a, b)


def test_decontamination(spark, docs_of, clashing):
    r = random.Random(6)
    items = [(i, " ".join(f"v{r.randint(0, 300)}" for _ in range(r.choice([6, 7, 13, 20, 41])))) for i in range(30)] + [(98, None), (99, "too short"), (97, "")]
    rows, expected = [], {}
    for i in range(120):
        words = [f"v{r.randint(0, 300)}" for _ in range(r.randint(0, 80))]
        if r.random() < 0.6:
            item = list(r.choice(items[:30])[1].split())
            for _ in range(r.randint(0, len(item) // 5)):
                item[r.randrange(len(item))] = r.choice(["zz", "q"])
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() + r.choice(["", ",", "!"]) for w in item]
        rows.append((i, r.choice([" ", "\n"]).join(words)))
    rows += [(500, None), (501, "")]
    plain = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in lower(t or "")).split()]
    for i, t in rows:
        found = [(k, plain_distance(plain(x), plain(t))) for k, x in items if x and len(x.split()) >= 6]
        expected[i] = [(k, d) for k, d in found if d <= int(len(plain(dict(items)[k])) * decontam.RATE)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for part_bytes in (1 << 20, 300):
        out = decontam.decontaminate(clashing(docs_of(rows)), bench, part_bytes=part_bytes)
        assert {x.doc_id: [(h.item_id, h.edits) for h in x.hits] for x in out.collect()} == expected
    assert any(d > 0 for e in expected.values() for _, d in e)
    df = docs_of(rows)
    cleaned = decontam.clean(df, bench)
    assert cleaned.columns == df.columns and sorted(x.doc_id for x in cleaned.collect()) == sorted(i for i, e in expected.items() if not e)
    assert decontam.decontaminate(df, bench.limit(0)).filter("size(hits) > 0").count() == 0
    assert decontam.decontaminate(df.limit(0), bench).count() == 0


def test_short_items_are_found_as_they_stand(spark, docs_of):
    items = [(1, "Capital: Paris"), (2, "yes"), (3, "one two three four five"), (4, "one two three four five six seven"), (5, " ?!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(0, "the CAPITAL, paris!"), (1, "capital of Paris"), (2, "Yes"), (3, "x one two three four five yes"), (4, "one two three four"), (5, "one two three four six seven"), (6, "capital"), (7, "paris yesterday"), (8, ""), (9, "?!")]
    for part_bytes in (1 << 20, 4):
        out = decontam.decontaminate(docs_of(rows), bench, part_bytes=part_bytes).collect()
        assert {x.doc_id: [(h.item_id, h.edits, h.word) for h in x.hits] for x in out if x.hits} == {0: [(1, 0, 1)], 2: [(2, 0, 0)], 3: [(2, 0, 6), (3, 0, 1)], 5: [(4, 1, 0)]}
    assert sorted(x.doc_id for x in decontam.clean(docs_of(rows), bench).collect()) == [1, 4, 6, 7, 8, 9]


def test_least_edits_and_clashing_names(spark, docs_of):
    """An exact copy counts though an edited one stands before it; columns of the input stay as they are."""
    item = " ".join(f"v{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id bigint, text string")
    near = item.replace("v7", "zz")
    rows = [(0, f"{near} and then {item}"), (1, f"{item} {near}"), (2, near), (3, "none of it"), (2, near), (4, f"{'x ' * 300_000}{near}")]
    df = docs_of(rows).withColumns({"hits": F.lit("mine"), "more": F.lit(5), "text_": F.lit("t")})
    found = {(x.doc_id, tuple((h.item_id, h.edits, h.word) for h in x.found)) for x in decontam.decontaminate(df, bench, hits_col="found").collect()}
    assert found == {(0, ((1, 0, 14), (2, 0, 14))), (1, ((1, 0, 0), (2, 0, 0))), (2, ((1, 1, 0), (2, 1, 0))), (3, ()), (4, ((1, 1, 300_000), (2, 1, 300_000)))}
    left = decontam.clean(df, bench)
    assert left.columns == df.columns and [(x.doc_id, x.hits, x.more) for x in left.collect()] == [(3, "mine", 5)]
    assert decontam.decontaminate(df, bench).count() == 6
