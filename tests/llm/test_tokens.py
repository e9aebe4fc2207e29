import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from brindle.llm import tokens

SCHEMA = "doc_id long, text string, tokens string, section string"


def offsets(text):
    """Token spans in bytes by another library's encoder of the same vocabulary."""
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    table = {}
    for i, b in enumerate([*range(33, 127), *range(161, 173), *range(174, 256)]):
        table[chr(b)] = b
    k = 0
    for b in range(256):
        if b not in table.values():
            table[chr(256 + k)] = b
            k += 1
    spans, at = [], 0
    for t in tok.encode(text, add_special_tokens=False).tokens:
        spans.append((at, at + len(t)))
        at += len(t)
    return spans


def brute(text, rule):
    if not text:
        return [(0, 0, 0, 0)]
    cuts = [i + 1 for i, c in enumerate(text) if c == "\n"]
    if not cuts or cuts[-1] != len(text):
        cuts.append(len(text))
    section = []
    for i, c in enumerate(text):
        section += [sum(1 for e in cuts if e <= i)] * len(c.encode())
    counts = Counter()
    for s, e in offsets(text):
        own = section[s:e]
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "last":
            counts[own[-1]] += 1
        else:
            held = Counter(own)
            counts[min(held, key=lambda k: (-held[k], k))] += 1
    return [(k, s, e, counts[k]) for k, (s, e) in enumerate(zip([0, *cuts[:-1]], cuts))]


TEXTS = [
    None, "", "\n", "\n\n\n\n", "one line", "two\nlines", "a\n\n\n\nb\n", "é\nñandú\n\n  x  \n\ty", "😀😀\n😀 ß", "x = 1;\n\n\n    y = 2;\n", "   \n   \n end", "<|endoftext|>\nz",
]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_against_brute_force(spark, rule):
    rng = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rng.choice("ab é\n\n \t.,1😀") for _ in range(rng.randrange(90)))) for i in range(80)]
    rows += [(None, "no\nid"), (3, "two\ntimes"), (3, "two\ntimes")]
    df = spark.createDataFrame([(a, b, "clash", "clash") for a, b in rows], SCHEMA).repartition(3)
    want = [(d, *r) for d, t in rows for r in brute(t, rule)]
    assert sorted((tuple(r) for r in tokens.token_counts(df, rule).collect()), key=str) == sorted(want, key=str)


def test_boundary_crossing():
    ends, sections = np.array([4, 10, 12]), np.array([1, 7, 8, 12])
    assert tokens.attribute(ends, sections, "most").tolist() == [0, 2, 0, 1]
    assert tokens.attribute(ends, sections, "first").tolist() == [1, 1, 0, 1]
    assert tokens.attribute(ends, sections, "last").tolist() == [0, 1, 0, 2]
    assert tokens.attribute(np.array([2]), np.array([1, 2]), "most").tolist() == [1, 0]


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 300_000 + "end", "word " * 100_000, "\n" * 50_000, "a " + "é" * 100_000 + "   b" * 10])
def test_long_texts(text):
    ends = tokens.Encoder().ends(text)
    assert ends[-1] == len(text.encode())
    assert tokens.attribute(ends, tokens.paragraphs(text.encode())).sum() == len(ends)


def test_empty(spark):
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("blank", ["\n", " ", "\u3000"])
@pytest.mark.parametrize("before, after", [("a", "b"), ("", "b"), ("a", ""), ("", "")])
def test_long_runs_of_blanks(blank, before, after):
    encoder = tokens.Encoder()
    long = before + blank * 1_500_000 + after
    ids = encoder.ids(long)
    assert encoder.encoding.decode(ids) == long
    # By hand as by the matcher, on a run that the matcher takes.
    short, whole = before + blank * 3001 + after, encoder.encoding

    class Refusing:
        _encode_single_piece = staticmethod(whole._encode_single_piece)

        @staticmethod
        def encode_ordinary(text):
            if len(text) > 3000:
                raise RuntimeError("refused")
            return whole.encode_ordinary(text)

    expected = encoder.ids(short)
    encoder.encoding = Refusing
    assert encoder.ids(short) == expected


@pytest.mark.parametrize("error", [KeyboardInterrupt, SystemExit, MemoryError])
def test_other_ends_are_not_the_matchers_limit(error):
    encoder = tokens.Encoder()

    class Ending:
        @staticmethod
        def encode_ordinary(text):
            raise error

    encoder.encoding = Ending
    with pytest.raises(error):
        encoder.ids("some words to cut between")
