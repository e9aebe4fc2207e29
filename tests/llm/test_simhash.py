import random
import re

import pytest
import xxhash

from brindle.llm import shingles, simhash

SCHEMA = "doc_id long, text string, fp string, rep string"


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """{doc: fingerprint} -> {doc: smallest reachable}"""
    ids = sorted(prints)
    out = {}
    for i in ids:
        if i in out:
            continue
        out[i], todo = i, [i]
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in out and (prints[x] ^ prints[y]).bit_count() <= 3:
                    out[y] = i
                    todo.append(y)
    return out


def random_text(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_documents(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "One\x0bTWO three"), (8, "É é"), (9, "a b c d")]
    for i in range(100, 160):
        base = random_text(rng, 400)
        rows += [(i * 10 + k, " ".join(w if rng.random() > 0.004 * k else "changed" for w in base.split())) for k in range(4)]
    rows += [(9000 + i, "the very same text as all the others have") for i in range(500)]
    df = spark.createDataFrame([(a, b, "clash", "clash") for a, b in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_components(df).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == brute_components(prints)


@pytest.mark.parametrize("cell", [simhash.CELL, 16])
def test_planted_fingerprints(spark, cell):
    rng = random.Random(3)
    prints = []
    for _ in range(40):
        f = rng.getrandbits(64)
        prints += [f] + [f ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4, 5)]
    base = rng.getrandbits(64)
    prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 3))) for _ in range(300)]
    prints = {i: f for i, f in enumerate(dict.fromkeys(prints))}
    reps = spark.createDataFrame([(f - ((f >> 63) << 64), i) for i, f in prints.items()], "fp long, rep long")
    from brindle.llm.components import components

    found = {r.node: r.component for r in components(simhash.near_links(reps, cell=cell)).collect()}
    assert {i: found.get(i, i) for i in prints} == brute_components(prints)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_components(empty).count() == 0 and shingles.one_of_each(empty).count() == 0
    df = spark.createDataFrame([(None, "x y z", "", ""), (5, "x y z", "", ""), (5, "x y z", "", ""), (None, "else", "", "")], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_components(df).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None)], key=str)


def test_long_path_of_links(spark):
    from brindle.llm.components import components

    n = 600
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5000, 5000), (7000, 6000), (6000, 7000)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {6000: 6000, 7000: 6000}


def test_unrelated_texts_without_or_with_one_id(spark):
    near = random_text(random.Random(2), 400)
    other, third = (random_text(random.Random(k), 400) for k in (3, 4))
    rows = [(7, near), (None, near + " " + near), (None, other), (9, third), (9, other + " x" * 40)]
    prints = {k: brute_print(t) for k, (_, t) in enumerate(rows)}
    found = brute_components(prints)
    last = (1 << 63) - 1
    least = {c: min(last if rows[k][0] is None else rows[k][0] for k in rows_of) for c in set(found.values()) if (rows_of := [k for k in found if found[k] == c])}
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)
    got = sorted(((r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_components(df).collect()), key=str)
    assert found[0] == found[1] != found[2]
    assert got == sorted(((prints[k], None if least[found[k]] == last else least[found[k]]) for k in prints), key=str)


def test_long_texts_are_taken_whole(monkeypatch):
    """Chunks of hashes add up: with chunks of 50 as with one, against the brute force."""
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(40_000))
    whole = simhash.fingerprint(text.encode())
    assert whole == brute_print(text)
    monkeypatch.setattr(simhash, "_CHUNK", 50)
    assert simhash.fingerprint(text.encode()) == whole


def test_what_an_explode_makes_is_not_broadcast(spark, monkeypatch):
    """Spark takes the look-ups, some 34 for each fingerprint, for as small as the file of the fingerprints."""
    plans = {}

    class Seen(simhash.Kept):
        def __init__(self, df, label):
            plans[label] = df._jdf.queryExecution().executedPlan().toString()
            super().__init__(df, label)

    monkeypatch.setattr(simhash, "Kept", Seen)
    rng = random.Random(5)
    texts = [(i, random_text(rng, 30), "", "") for i in range(300)]
    texts += [(1000 + i, " ".join([t, "more"]), "", "") for i, t, _, _ in texts[:50]]
    df = spark.createDataFrame(texts, SCHEMA)
    for cell in (simhash.CELL, 1):
        plans.clear()
        reps = simhash.Kept(df.selectExpr("xxhash64(text) % 5000 as fp").distinct().selectExpr("fp", "fp as rep"), "some").df
        links = simhash.near_links(reps, cell=cell)
        assert "SortMergeJoin" in plans["cells"] and "Broadcast" not in plans["cells"]
        assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    found = simhash.near_components(df)
    assert "reps" in plans and found.count() == len(texts)
    # The documents' fingerprints are never the side that is sent, however well their file compresses.
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
