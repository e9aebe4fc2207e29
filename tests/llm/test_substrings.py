import hashlib
import random
import re

import numpy as np
import pytest

from brindle.llm import substrings

SCHEMA = "doc_id long, text string, doc string, blob string, row string"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows):
    starts = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            d = 1 << 63 if doc is None else doc
            starts[k] = min(starts.get(k, d), d)
    out = []
    for doc, text in rows:
        w, gone = words_of(text), set()
        for i in range(len(w) - 12):
            if starts[tuple(w[i : i + 13])] < (1 << 63 if doc is None else doc):
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def longest(text, pattern, most):
    """How many numbers from each place of pattern on are somewhere in text, at most so many."""
    runs = {tuple(text[i : i + n]) for n in range(1, most + 1) for i in range(len(text) - n + 1)}
    out = []
    for i in range(len(pattern)):
        n = 0
        while n < most and i + n < len(pattern) and tuple(pattern[i : i + n + 1]) in runs:
            n += 1
        out.append(n)
    return out


@pytest.mark.parametrize("words", [2, 5, 90])
def test_matching_statistics_against_scan(words):
    """Texts of the index, other texts and numbers that the index does not have; intervals hold as many rows as there are matches."""
    rng = random.Random(words)
    parts = [[rng.randrange(1, words + 1) for _ in range(rng.randrange(1, 60))] for _ in range(30)]
    text = np.array([x for p in parts for x in (*p, 0)])
    index = substrings.FMIndex(text)
    asked = [*parts, *([rng.randrange(0, words + 3) for _ in range(rng.randrange(1, 80))] for _ in range(30))]
    flat = np.array([x for p in asked for x in p])
    lengths = np.array(list(map(len, asked)))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    found, low, high = index.matching_statistics(flat, starts, lengths)
    inside = [x for p in parts for x in (*p, 0)]
    for p, s in zip(asked, starts.tolist()):
        want = longest(inside, p, 13)
        want = [min(n, p[i:].index(0)) if 0 in p[i : i + n] else n for i, n in enumerate(want)]  # no match goes over a 0
        assert found[s : s + len(p)].tolist() == want
        for i, n in enumerate(want):
            if n:
                assert high[s + i] - low[s + i] == sum(inside[k : k + n] == p[i : i + n] for k in range(len(inside)))


def test_bits():
    rng = np.random.default_rng(3)
    bits = rng.random(1000) < 0.1
    held = substrings.Bits(bits)
    ones = np.flatnonzero(bits)
    assert held.select(np.arange(1, len(ones) + 1)).tolist() == ones.tolist()
    assert held.rank(np.arange(1001)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()


def made_up():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(300)}"
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (12, 13, 14, 20, 60)]
    rows = []
    for i in range(150):
        t = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t) + 1)
            t[k:k] = rng.choice(passages)
        rows.append((i * 3 % 151, "\n\t "[i % 3].join(t)))
    copy = " ".join(text(200))
    rows += [(1000 + i, copy) for i in range(60)]
    near = text(150)
    for i in range(60):
        t = list(near)
        t[rng.randrange(150)] = "changed"
        rows.append((2000 + i, " ".join(t)))
    rows += [(3000, None), (3001, ""), (3002, "ado " * 300), (3003, "ado " * 50), (3004, " ".join(passages[4]) + " É  x"), (None, copy), (None, " ".join(passages[4]))]
    rows += [(5000, copy), (5000, " ".join(near)), (5001, "x y " * 40), (5001, "x y " * 40), (5002, " ".join(text(30000)))]
    return rows


@pytest.mark.parametrize(("parts", "slice_bytes"), [(1, 4 << 20), (6, 2000), (3, 20_000)])
def test_documents(spark, parts, slice_bytes):
    """Whole texts in one slice, and equal passages spread over many slices, against a scan of all windows."""
    rows = made_up()
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame([(a, b, "clash", "clash", "clash") for a, b in rows], SCHEMA).repartition(parts)
    found = substrings.cut_slices(df, slice_bytes)
    got = sorted(map(tuple, found.mapInArrow(substrings._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()), key=str)
    want = brute(rows)
    assert [g for g in got if g not in want][:3] == [] and got == want


def test_kept_words(spark):
    rows = made_up()
    df = spark.createDataFrame([(a, b, "clash", "clash", "clash") for a, b in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.without_repeats(df).collect()), key=str)
    assert got == brute(rows)


def test_one_phrase_in_many_documents(spark):
    """A hot anchor: its windows go to shards of their own; small shards, so that it would not fit one."""
    rng = random.Random(9)
    phrase = [f"p{i}" for i in range(11)]
    word = lambda: f"w{rng.randrange(40)}"
    rows = [(i, " ".join([word() for _ in range(3)] + phrase + [word() for _ in range(3)])) for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    for hot in (1, 100, 10**9):
        found = substrings.cut_slices(df, 20_000, shard_bytes=50_000, hot=hot)
        got = sorted(map(tuple, found.mapInArrow(substrings._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()), key=str)
        assert got == want and sum(g[2] for g in got) > 1000


def test_windows_with_one_doc_join():
    piece, offset, doc = np.array([0, 0, 0, 0, 0, 2, 3]), np.array([0, 1, 2, 3, 5, 6, 7]), np.array([4, 4, 4, 5, 5, 5, 5])
    assert [x.tolist() for x in substrings._runs(piece, offset, doc)] == [[0, 0, 0, 2, 3], [0, 3, 5, 6, 7], [3, 1, 1, 1, 1], [4, 5, 5, 5, 5]]


def test_empty(spark):
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
