"""The two substring operators and the line operator, against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from baseloom.llm import line_dedup, substring_dedup, suffix_dedup
from tests.llm.conftest import opposite_words

ODD = [(90, None), (91, ""), (92, " \n "), (93, "one"), (None, "null id here"), (94, "é" * 30), (95, "ab" * 400), (96, "ab" * 401), (97, "w " * 900)]


def key(i):
    return -(2**63) if i is None else i


def by_id(rows):
    return sorted(rows, key=lambda r: key(r[0]))


def brute_words(rows, w):
    seen, out = set(), []
    for i, t in by_id(rows):
        words = (t or "").encode().split()
        off = [False] * len(words)
        for s in range(len(words) - w + 1):
            k = tuple(words[s : s + w])
            if k in seen:
                off[s : s + w] = [True] * w
            seen.add(k)
        kept = b" ".join(x for x, o in zip(words, off) if not o).decode()
        out.append((key(i), len(words), sum(off), kept))
    return sorted(out)


def brute_bytes(rows, d):
    seen, out = set(), []
    for i, t in by_id(rows):
        b = (t or "").encode()
        off = [False] * len(b)
        for s in range(len(b) - d + 1):
            if b[s : s + d] in seen:
                off[s : s + d] = [True] * d
            seen.add(b[s : s + d])
        runs = sum(o and (j == 0 or not off[j - 1]) for j, o in enumerate(off))
        out.append((key(i), len(b), sum(off), runs, bytes(x for x, o in zip(b, off) if not o)))
    return sorted(out)


def random_rows(seed, n=60, letters="abc", copies=True):
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        words = ["".join(r.choices(letters, k=r.randint(1, 3))) for _ in range(r.randint(0, 60))]
        if copies and texts and r.random() < 0.6:
            old = r.choice(texts)
            a = r.randint(0, len(old))
            words = words[: r.randint(0, len(words))] + old[a : a + r.randint(0, 40)] + words[-3:]
        texts.append(words)
        rows.append((i * 7 % 101, r.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("seed, window", [(1, 20), (2, 5), (3, 8), (4, 1), (5, 2), (6, 13)])
def test_words(docs_of, clashing, seed, window):
    rows = random_rows(seed) + (ODD if seed < 3 else [])
    df = docs_of(rows)
    got = substring_dedup.substring_dedup(clashing(df) if seed == 1 else df, window)
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == brute_words(rows, window)


@pytest.mark.parametrize("seed, depth", [(1, 100), (2, 20), (3, 40), (4, 7), (5, 1)])
def test_bytes(docs_of, clashing, seed, depth):
    rows = random_rows(seed, letters="abé") + (ODD if seed < 3 else [])
    df = docs_of(rows)
    got = suffix_dedup.suffix_dedup(clashing(df) if seed == 1 else df, depth)
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == brute_bytes(rows, depth)


def test_small_flushes(docs_of, monkeypatch):
    """Much passes between tasks when each sends little at a time."""
    import baseloom.llm._windows as W

    monkeypatch.setattr(W, "FLUSH", 50)
    monkeypatch.setattr(substring_dedup, "FLUSH", 50)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 50)
    rows = random_rows(9, 80)
    got = substring_dedup.substring_dedup(docs_of(rows, 5), 6).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute_words(rows, 6)
    got = suffix_dedup.suffix_dedup(docs_of(rows, 5), 30).collect()
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(rows, 30)


def test_repeated_rows_and_empty_tables(docs_of):
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.substring_dedup(docs_of([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 30)]
    got = suffix_dedup.suffix_dedup(docs_of([(1, text), (1, text), (2, text)]), 50).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, len(text))]
    for f in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, line_dedup.line_dedup):
        assert f(docs_of([(1, "a")]).limit(0)).count() == 0


def test_words_that_sums_of_powers_confuse(docs_of):
    for size in (1024, 2048, 4096):
        one, two = opposite_words(size)
        rest = " ".join(f"w{i}" for i in range(19))
        rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")]
        got = substring_dedup.substring_dedup(docs_of(rows)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_words(rows, 20)
    one, two = opposite_words(1024)
    rows = [(1, one), (2, two), (3, f"{two}{one}")]
    got = suffix_dedup.suffix_dedup(docs_of(rows), 1024).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(rows, 1024)


def test_radix_passes_order_and_group():
    """What isn't alone comes in the order of its bytes, equal windows in one group."""
    import numpy as np

    r = random.Random(3)
    for depth in (1, 3, 8, 9, 20):
        data = bytes(r.choice(b"ab\xff") for _ in range(300))
        at = np.arange(300 - max(depth, 8) + 1)
        first = [np.array([data[i] & 1 for i in at])]
        left, group = suffix_dedup.sorted_groups(first, np.frombuffer(data, np.uint8), at, depth)
        windows = [(data[i] & 1, data[i : i + depth]) for i in at]
        again = [w for w in windows if windows.count(w) > 1]
        assert [windows[i] for i in left] == sorted(again) and len(set(group.tolist())) == len(set(again))
        assert all((a == b) == (windows[i] == windows[j]) for a, b, i, j in zip(group, group[1:], left, left[1:]))


@pytest.mark.parametrize("most_kinds", [0, 1, 2, 5])
def test_grams_of_many_kinds(docs_of, most_kinds):
    """Suffixes that are dealt one by one, beside those that are sorted together."""
    rows = random_rows(11, 50)
    got = suffix_dedup.suffix_dedup(docs_of(rows), 24, gram=6, most_kinds=most_kinds).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(rows, 24)


def test_a_text_of_several_blocks(docs_of):
    """A window in a text of over a megabyte is the same as in a short one."""
    r = random.Random(9)
    passage = " ".join(f"p{r.randint(0, 10**6)}" for _ in range(40))
    filler = " ".join(f"f{i}" for i in range(230_000))
    rows = [(1, passage), (2, f"{filler} {passage} {filler[::-1]}"), (3, f"{passage} end")]
    assert len(rows[1][1]) > 3 << 20
    words = {x.doc_id: x.n_removed for x in substring_dedup.substring_dedup(docs_of(rows)).collect()}
    assert words == {1: 0, 2: 40, 3: 40}
    gone = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.suffix_dedup(docs_of(rows)).collect()}
    assert gone[1] == (0, 0) and gone[3][0] >= len(passage) and gone[2][0] >= len(passage)


def test_lines_of_repeated_rows_and_ties(docs_of, clashing):
    """Rows that share the largest id all keep their lines; equal rows count each."""
    line = "a line of over forty characters, here it is again"
    rows = [(i, f"{line}\nown {i}") for i in range(4)] * 2 + [(9, line), (9, f"{line}\nx"), (9, "no line of that kind")] + [(3, "y" * 2_000_000)]
    got = line_dedup.line_dedup(clashing(docs_of(rows)))
    assert sorted((key(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute_lines(rows)


def test_covers():
    for period, residues in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))
    for window in range(1, 60):
        period, _, width = substring_dedup.cover_for(window)
        assert width >= 1 and period - 1 + width <= window


def brute_lines(rows, min_chars=40, min_docs=5):
    def k(line):
        s = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)

    split = [(key(i), (t or "").split("\n")) for i, t in rows]
    docs = {}
    for n, (i, lines) in enumerate(split):
        for x in {k(x) for x in lines}:
            docs.setdefault(x, []).append(i)
    out = []
    for i, lines in split:
        kept = [x for x in lines if not (len(k(x)) >= min_chars and len(docs[k(x)]) >= min_docs and i < max(docs[k(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines(docs_of, clashing):
    long, edge, short = "This Line Is Longer Than forty characters, surely", "é" * 40, "é" * 39
    rows = [(i, f"own line number {i}\n  {long if i % 2 else long.upper()}\t\n{edge}\n{short}\n {edge}") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, f"{long}\n{long}"), (24, "x" * 50), (25, f"{'x' * 50}\r"), (None, long)]
    got = line_dedup.line_dedup(clashing(docs_of(rows)))
    assert sorted((key(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute_lines(rows)


def test_lines_with_a_full_filter(docs_of):
    """False suspects cost work alone."""
    r = random.Random(3)
    rows = [(i, "\n".join(f"{'line' * 11} {r.randint(0, 90)}" for _ in range(9))) for i in range(60)]
    got = line_dedup.line_dedup(docs_of(rows), bits=1)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute_lines(rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=12))
def test_any_texts(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.substring_dedup(df, 3).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_words(rows, 3)
    got = suffix_dedup.suffix_dedup(df, 5).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(rows, 5)
