import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from brindle.llm import packing

SCHEMA = "doc_id long, text string, length long, piece string"


def tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))


TEXTS = [
    None, "", " \t\n", "Hello, World!! it's 2024 now", "Éa ß ÖÄ ñ ª² \x85 x\x1cy", "don't  'S they'LL <|endoftext|> a<|startoftext|>b <| x",
    "Σας ΟΔΟΣ é ́x ﬁ İstanbul 中文字 😀 z", "tab\tand\x0bvt\x0cff", "a" * 3000, "word " * 5000, "é" * 1500 + " ok", "### $$$ %%% | a|b |",
]


def test_ids_are_the_tokenizers():
    tok = tokenizer()
    chunks = packing.Chunks(packing.vocabulary_path(packing.VOCABULARY))
    rng = random.Random(2)
    signs = "abcXYZéÉßñ0123456789 \n\t'.,!|$# ́Σ中😀<>-_"
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    ids, ends = chunks.encode_all(texts)
    start = 0
    for t, end in zip(texts, ends):
        assert ids[start:end].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t
        start = end


def test_tree_against_scan():
    rng = random.Random(5)
    tree, held = packing.Tightest(50), defaultdict(int)
    for _ in range(3000):
        c = rng.randrange(51)
        if held[c] and rng.random() < 0.6:
            held[c] -= 1
            tree.add(c, -1)
        else:
            held[c] += 1
            tree.add(c, 1)
        least = rng.randrange(51)
        assert tree.find(least) == min((x for x in held if held[x] and x >= least), default=-1)


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 700)
    number, offset = packing.best_fit(lengths, 100)
    left = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(x, b) for b, x in enumerate(left) if x >= lengths[i]]
        if fits:
            tight = min(fits)[0]
            assert 100 - offset[i] == tight
            left[number[i]] -= lengths[i]
        else:
            assert offset[i] == 0 and number[i] == len(left)
            left.append(100 - lengths[i])
    assert len(left) <= -(-lengths.sum() // 100) * 11 // 9 + 1


@pytest.mark.parametrize("group", [packing.GROUP, 40])
def test_pack(spark, group):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "again"), (4, "twice"), (4, "twice")] + [(100 + i, "some more words " * (i % 60)) for i in range(200)]
    df = spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], SCHEMA).repartition(3)
    got = packing.pack(df, group=group).collect()
    tok, want = tokenizer(), []
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((doc, k // 2048, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert group < 1000 or len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_equal_rows_spread_over_groups(spark):
    """3,000 equal rows among others: no group holds many more pieces than it should, and little is wasted."""
    rows = [(i, "some more words " * (i % 40)) for i in range(500)] + [(7, "one text that very many rows have " * 20)] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    least = None
    for group in (100, 500, 10**6):
        got = packing.pack(df, group=group).collect()
        groups = defaultdict(int)
        for r in got:
            groups[r.sequence_id >> 32] += 1
        used = len({r.sequence_id for r in got})
        least = -(-sum(r.length for r in got) // 2048)
        assert len(got) == 3500 and max(groups.values()) < 1.6 * group
        assert used <= least * 1.02 + len(groups)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_forget_and_know_again(monkeypatch):
    """Words with signs of all kinds, with a memory that begins anew again and again, against whole texts."""
    monkeypatch.setattr(packing, "REMEMBER", 20)
    monkeypatch.setattr(packing, "PIECES_KEPT", 30)
    rng = np.random.default_rng(6)
    words = ["Word", "naïve", "don't", "rock'n'roll", "x1", "42", "µm", "'s", "ÄÖ", "a-b", "<|x|>"] + [f"w{'abcdef'[i % 6] * (i % 4 + 1)}" for i in range(40)]
    signs = ["", ".", "!!", "$$$", "...'", "'", ",)", "“", "%%%", "'s", "*a*"]
    chunks, tok = packing.Chunks(packing.vocabulary_path(packing.VOCABULARY)), tokenizer()
    for _ in range(40):
        texts = [" ".join(str(rng.choice(words)) + str(rng.choice(signs)) for _ in range(30)) for _ in range(3)]
        ids, ends = chunks.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
