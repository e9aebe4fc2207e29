import itertools
import os
import zlib

import numpy as np
import pytest

from brindle.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, held_out string"
SF = "/root/testdata/sf0.1"


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 4, 2, 5])
    starts = np.array([0, 1, 5, 7])
    psi, t, start = rng.random((12, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    alpha, beta, total = langid.forward_backward(psi, t, starts, lengths, start)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    logs = 0.0
    for s, n in zip(starts, lengths):
        sums, z = np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            w = start[path[0]] * psi[s, path[0]]
            for i in range(1, n):
                w *= t[path[i - 1], path[i]] * psi[s + i, path[i]]
            z += w
            for i, k in enumerate(path):
                sums[i, k] += w
        assert np.allclose(p[s : s + n], sums / z)
        logs += np.log(z)
    assert np.isclose(total, logs)


def test_potentials_do_not_depend_on_the_pieces(monkeypatch):
    model = langid.fit([("en", b"the word and that one"), ("de", "der die und für das".encode())], epochs=5)
    a = np.append(np.uint8(32), langid.normal("the Über words, and more für one ".encode() * 40))
    whole, _ = model.potentials(a)
    monkeypatch.setattr(langid, "_BYTES", 50)
    parts, _ = model.potentials(a)
    assert np.allclose(whole, parts)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    got = langid.identify(docs, model).collect()
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    hits = [r.lang_pred == want[r.doc_id] for r in got if r.held_out]
    print(np.mean(hits), len(hits))
    assert np.mean(hits) > 0.97
    # Words of code-switched text get their own languages.
    texts = {k: next(r.text for r in docs.where(f"lang = '{k}' and n_chars > 900").limit(1).collect()) for k in ("en", "de")}
    mixed = " ".join(texts["en"].split()[:40] + texts["de"].split()[:40])
    rows = sorted(langid.label_words(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect(), key=lambda r: r.start)
    path = [r.lang_pred for r in rows]
    assert path[: len(path) // 2].count("en") > 30 and path[len(path) // 2 :].count("de") > 30
    assert all(r.probability > 0.4 for r in rows)


def test_words_and_their_places(spark):
    model = langid.fit([("en", b"the word and that one")] * 9 + [("de", "der die und für das".encode())] * 9, epochs=10)
    text = "für, das 12 the-word ÄÖ •• and"
    rows = [(1, text), (2, None), (3, "12 ••"), (None, "die"), (1, text)]
    got = langid.label_words(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    words = sorted((text[r.start : r.end], r.lang_pred) for r in got if r.doc_id == 1)
    assert [w for w, _ in words] == sorted(["für", "das", "the", "word", "ÄÖ", "••", "and"] * 2)
    assert {("für", "de"), ("the", "en"), ("and", "en")} <= set(words)
    assert {r.doc_id for r in got} == {1, None} and all(0 < r.probability <= 1 for r in got)
    nothing = langid.label_words(spark.createDataFrame(rows, "doc_id long, text string"), langid.fit([]))
    assert nothing.count() == 0


def test_pair_expectations_against_all_pairs():
    rng = np.random.default_rng(5)
    alpha, later, t, after = rng.random((50, 4)), rng.random((50, 4)), rng.random((4, 4)), np.arange(1, 50, 2)
    joint = alpha[after - 1][:, :, None] * t[None] * later[after][:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    assert np.allclose(langid.pair_expectations(alpha, later, t, after), joint.sum(axis=0))


def test_fitting_in_parts_is_fitting(monkeypatch):
    samples = [("en", b"the word and that one is here")] * 40 + [("de", "der die und für das ist".encode())] * 40
    whole = langid.fit(samples, epochs=4)
    monkeypatch.setattr(langid, "_PART", langid.SEQUENCE * 2)
    parts = langid.fit(samples, epochs=4)
    assert np.allclose(whole.transitions, parts.transitions) and np.allclose(whole.own, parts.own, atol=1e-5)


def test_whole_texts_are_learned_from(spark):
    """All words of a long text, and one row of an id that many rows have."""
    long = " ".join(f"w{i % 26 * 'a'}{i % 7 * 'b'}" for i in range(5000))
    assert b" ".join(langid.stretches(long.encode())) == long.encode() and langid.stretches(None) == []
    rows = [(1, long, "en"), (3, "der die das", "de")] + [(4, f"la le {i}", "fr") for i in range(500)]
    seen = []
    fit, langid.fit = langid.fit, lambda samples: seen.extend(samples) or fit(samples, epochs=1)
    try:
        langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), parts=10**9, held_out=-5, most=2)
    finally:
        langid.fit = fit
    assert sum(len(p.split()) for lang, p in seen if lang == "en") == 5000 and sum(lang == "fr" for lang, _ in seen) == 1


def test_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the one and that is of the words", "en"), ("der die das und ist nicht für", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 456 !!", "en"), (103, "the " * 60_000, None), (104, "中文字", None), (None, "der die das", "de"), (105, "•• …", "de"), (0, rows[0][1], "en")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = langid.identify(df, langid.learn(df)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (100, 101, 102, 105))
    assert by_id[103].lang_pred == "en" and by_id[None].lang_pred == "de" and not by_id[None].held_out and by_id[104].lang_pred != "und"
    empty = df.limit(0)
    assert langid.identify(empty, langid.learn(df)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.learn(empty)).collect()} == {"und"}
