"""Groups of documents whose sets of 5-word shingles are similar, against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import shingles

SCHEMA = "doc_id long, text string, source string"


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def kept_ids(rows):
    """Of each component of all pairs with Jaccard >= 0.8 the smallest id."""
    at, out = {}, set()
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    for i in ids:
        if i in at:
            continue
        at[i], todo = i, [i]
        out.add(i)
        while todo:
            x = sets[todo.pop()]
            for y in ids:
                if y not in at and 4 * len(x) <= 5 * len(sets[y]) and 4 * len(sets[y]) <= 5 * len(x) and 5 * len(x & sets[y]) >= 4 * len(x | sets[y]):
                    at[y] = i
                    todo.append(y)
    return out


def text(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def changed(rng, base, k):
    w = base.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("cell", [shingles.CELL, 8])
def test_against_all_pairs(spark, cell):
    rng = random.Random(7)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    for n in (12, 60, 300, 516, 1028):  # the last two on both sides of a doubling of the parities
        for _ in range(8):
            base = text(rng, n)
            texts += [base, base.upper(), base + " " + base, *(changed(rng, base, k) for k in range(1, 1 + max(2, n // 30)))]
    # Members of one family that are about as far apart as the limit, a chain, a common line, repeated sets.
    base, line = text(rng, 200), text(rng, 12)
    texts += [changed(rng, base, k) for k in (1, 2, 3, 4, 5) for _ in range(12)]
    chain = text(rng, 150).split()
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 50, 5)]
    texts += [f"{line} {text(rng, 40)}" for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shingles.near_components(docs, cell=cell).groupBy("component").agg(F.min("rep").alias("r")).select("r.doc_id").collect()
    want = kept_ids(rows)
    assert {r.doc_id for r in got} == want and len(got) == len(want)


def test_stage_on_all_documents(spark):
    """Most of these pairs are further apart than three bits of a fingerprint."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = kept_ids([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = [r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").select("doc_id").collect()]
    assert sorted(got) == sorted(want)


def test_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c = text(rng, 100), text(rng, 100), text(rng, 100)
    rows = [(None, a + " x", "1"), (7, a, "2"), (None, b, "3"), (None, b, "4"), (None, b + " x", "5"), (5, c, "6"), (5, text(rng, 50), "7"), (4, c + " x", "8")]
    got = sorted(r.source for r in shingles.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got in (["2", "3", "7", "8"], ["2", "4", "7", "8"], ["2", "5", "7", "8"])  # of 3, 4, 5 without ids any one
    rows = [(1, a, "1"), (None, a, "2"), (None, b, "3"), (None, b, "4"), (9, c, "5"), (9, c, "6")]
    got = sorted(r.source for r in shingles.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[0] == "1" and len(got) == 3 and got[1] in "34" and got[2] in "56"
    assert shingles.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sides_that_grow_with_the_table_are_not_broadcast(spark, monkeypatch):
    """Files of this size are below Spark's threshold; what is made of them by an explode, or its sparse bits, need not be."""
    plans = {}

    class Seen(shingles.Kept):
        def __init__(self, df, label):
            plans[label] = df._jdf.queryExecution().executedPlan().toString()
            super().__init__(df, label)

    monkeypatch.setattr(shingles, "Kept", Seen)
    rng = random.Random(9)
    rows = [(i, text(rng, 60), "") for i in range(40)]
    rows += [(100 + i, t + " more", "") for i, t, _ in rows[:20]]
    assert shingles.near_components(spark.createDataFrame(rows, SCHEMA)).select("component").distinct().count() == 40
    for label in ("cells", "pairs", "similar"):
        joins = re.findall("SortMergeJoin|BroadcastHashJoin", plans[label])
        assert joins[:1] == ["SortMergeJoin"] and (label == "cells" or joins[1] == "SortMergeJoin"), label
