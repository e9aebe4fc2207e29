import os
import zlib

import numpy as np
import pytest

from brindle.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string"
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == docs.count()
    want = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    test = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert len(test) > 1000
    for label in (0, 1):
        hits = [p == y for p, y in test if y == label]
        print(label, np.mean(hits), len(hits))
        assert np.mean(hits) > 0.95


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_terms_carry_without_the_counters(spark):
    """With the three counters blanked out, both labels of the held-out fold are still told apart."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality in (0, 1)")
    rows = rows.select("doc_id", "text", "quality").collect()
    x = np.stack([quality.marks((r.text or "").encode()) for r in rows])
    x[:, quality.COUNTERS] = 0
    y, held = np.array([r.quality for r in rows]), np.array([zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows])
    learnt = np.concatenate([np.flatnonzero(~held & (y == label))[:1024] for label in (0, 1)])
    good = quality.Model(x[learnt], y[learnt]).score(x[held]) >= 0.5
    assert (good == y[held])[y[held] == 1].mean() > 0.95 and (good == y[held])[y[held] == 0].mean() > 0.75


def test_votes_against_brute_force(spark):
    rng = np.random.default_rng(0)
    counts, labels = rng.poisson(0.2, (60, quality.FEATURES)).astype(np.float32), rng.integers(0, 2, 60)
    model = quality.Model(counts, labels, dims=20, k=5)
    asked = rng.poisson(0.2, (9, quality.FEATURES)).astype(np.float32)
    got = model.score(asked)
    for i, row in enumerate(asked):
        x = np.sqrt(row / row.sum()) * model.idf
        x = (x / np.linalg.norm(x)) @ model.project
        x /= np.linalg.norm(x)
        near = sorted(((float(x @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[:5]
        weights = [max(1e-6, c) ** quality.POWER for c, _ in near]
        assert abs(got[i] - sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)) < 1e-4


def test_neither_ties_nor_order_of_the_sample_matter(spark):
    """40 equal labelled vectors, half of each label, in any order: all of them vote."""
    rng = np.random.default_rng(1)
    one, other = rng.poisson(0.5, (2, quality.FEATURES)).astype(np.float32)
    counts = np.concatenate([np.repeat(one[None], 40, axis=0), rng.poisson(0.5, (30, quality.FEATURES)).astype(np.float32)])
    labels = np.array([0, 1] * 20 + [0] * 30)
    scores = []
    for _ in range(5):
        order = rng.permutation(70)
        scores.append(quality.Model(counts[order], labels[order]).score(np.stack([one, other, one])))
    assert np.ptp(np.array(scores), axis=0).max() < 1e-6 and abs(scores[0][0] - 0.5) < 1e-9 and scores[0][0] == scores[0][2]


def test_equal_texts_score_alike_and_a_repeated_id_teaches_once(spark):
    rows = [(i, f"plain words number {i} here.") for i in range(40)] + [(100 + i, f"| # {i} | $ %") for i in range(40)]
    rows += [(7, f"| other {i} |") for i in range(200)] + [(1000 + i, "the same text | again") for i in range(300)]
    df = frame(spark, rows).repartition(7)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)], LABELS)
    model = quality.learn(df, labels)
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in [*range(40), *range(100, 140)])
    assert len({r.score for r in quality.score(df, model).where("doc_id >= 1000").collect()}) == 1


def frame(spark, rows):
    return spark.createDataFrame([(a, b, None, None, 0, "clash", "clash") for a, b in rows], DOCS)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (None, "no id"), (5, "a | b | c |"), (5, "a | b | c |"), (6, "x" * 300_000), (7, "plain words here.")]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(5, 0, 0), (7, 1, 0), (7, 1, 0), (None, 1, 0), (2, None, None), (3, 0, 1)], LABELS)
    got = quality.score(df, quality.learn(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = quality.good_documents(df, quality.learn(df, labels))
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.score(df, quality.learn(df, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 1, 0)], LABELS)
    assert all(abs(r.score - 1) < 1e-9 for r in quality.score(df, quality.learn(df, ones)).collect())
    empty = frame(spark, [])
    assert quality.score(empty, quality.learn(empty, labels)).count() == 0


def test_marks_add_up_over_chunks(monkeypatch):
    text = ("Some | text with, signs!! " * 300).encode()
    whole = quality.marks(text)
    monkeypatch.setattr(quality, "_CHUNK", 1000)
    parts = quality.marks(text)
    at = slice(quality._TRI, quality._TRI + quality._WORDS)
    assert (whole[at] == parts[at]).all() and whole[at].sum() == len(text.split())  # parts end behind white space
    assert np.abs(whole - parts).sum() <= 12 * (len(text) // 900)
