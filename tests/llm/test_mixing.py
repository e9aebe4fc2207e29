import math
from collections import defaultdict

from pyspark.sql import functions as F

from brindle.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, target string"


def water_fill(sizes):
    """Targets by the repeated rule: cap what is above, reshare among the rest."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def documents():
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 7}") for i in range(2000)]
    rows += [(5000 + i, "hot words " * (i % 11), "big") for i in range(1500)]
    rows += [(9000, None, "s1"), (9001, "", None), (9002, "a\x0bb c d", None), (9003, "x " * 20000, "Z"), (9004, "one", "é")]
    rows += [(None, "no id", "s2"), (7, "w " * 8, "s0"), (7, "w " * 8, "s0"), (9020, "other", "none"), (9010, None, "nothing")]
    return rows


def test_targets_and_budgets(spark):
    rows = documents()
    df = spark.createDataFrame([(a, b, c, 0, "x", "y") for a, b, c in rows], SCHEMA).repartition(7)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    import re

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += count(t)
    want = water_fill(sizes)
    by_id = {a: (count(b), s) for a, b, s in rows}
    taken = defaultdict(int)
    for r in got:
        size, source = by_id[r.doc_id]
        assert r.size == size and r.source_size == sizes[source]
        assert math.isclose(r.target, want[source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.taken >= r.size * (int(round(r.target)) // max(1, r.source_size))
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_order_of_keys_against_brute_force(spark):
    """Every document's share of what is left after whole epochs, from the keys themselves."""
    rows = [(i, "word " * (i % 9 + 1), f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame([(a, b, c, 0, "x", "y") for a, b, c in rows], SCHEMA).repartition(5)
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
    u = df.select("doc_id", (F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), 11) + 0.5).alias("u"))
    key = {r.doc_id: -math.log(r.u * 2.0**-53) / (1.0 if r.doc_id % 2 == 0 else 0.2) for r in u.collect()}
    got = {r.doc_id: r for r in mixing.mix(df, weight).collect()}
    for s in range(3):
        own = sorted((key[i], i) for i, _, source in rows if source == f"s{s}")
        size, target = got[own[0][1]].source_size, round(got[own[0][1]].target)
        left = target - target // size * size
        for _, i in own:
            part = min(got[i].size, left)
            left -= part
            assert got[i].taken == target // size * got[i].size + part
    heavy = [sum(got[i].taken for i in got if i % 2 == k) / sum(got[i].size for i in got if i % 2 == k) for k in (0, 1)]
    assert heavy[0] > heavy[1]


def test_learned_weights(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    weight = mixing.fit_weight(docs, labels)
    rows = docs.join(labels, "doc_id").where("quality in (0, 1)").select("quality", weight(F.col("text")).alias("w"), mixing.fold(F.col("doc_id"), 3).alias("fold")).collect()
    assert all(mixing.LEAST <= r.w <= 1 for r in rows)
    mean = {q: sum(r.w for r in rows if r.quality == q and r.fold == 1) / sum(r.quality == q and r.fold == 1 for r in rows) for q in (0, 1)}
    assert mean[1] > 2 * mean[0]
    same = mixing.fit_weight(docs.repartition(3), labels.repartition(3))
    texts = docs.limit(20)
    assert [r.w for r in texts.select(weight(F.col("text")).alias("w")).collect()] == [r.w for r in texts.select(same(F.col("text")).alias("w")).collect()]
    alike = mixing.fit_weight(docs, labels.where("quality = 1"))
    assert {r.w for r in docs.select(alike(F.col("text")).alias("w")).collect()} == {1.0}
    plan = mixing.mix(docs, weight(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_heavier_documents_come_sooner(spark):
    rows = [(i, "good words here and more " * 4, "a") for i in range(500)] + [(1000 + i, "| # $ % | # $ % | " * 4, "a") for i in range(500)]
    rows += [(2000 + i, "x " * 100, "b") for i in range(1000)]
    df = spark.createDataFrame([(a, b, c, 0, "x", "y") for a, b, c in rows], SCHEMA)
    weight = F.when(F.col("text").contains("|"), 0.1).otherwise(1.0)
    got = [r for r in mixing.mix(df, weight, share=0.5).collect() if r.doc_id < 2000]
    part = {r.doc_id: r.taken % r.size for r in got}
    whole = {r.doc_id: r.taken / r.size for r in got}
    assert sum(v for k, v in whole.items() if k < 1000) > 1.2 * sum(v for k, v in whole.items() if k >= 1000)
    assert sum(v > 0 for v in part.values()) <= 1


def test_documents_are_repeated_and_cut(spark):
    rows = documents()
    df = spark.createDataFrame([(a, b, c, 0, "x", "y") for a, b, c in rows], SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = out.select(mixing.words_in(out["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert words == sum(r.taken for r in mixing.mix(df).collect())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0
    nothing = spark.createDataFrame([(1, None, None, 0, "x", "y")], SCHEMA)
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.mix(nothing).collect()] == [(0, 0, 0.0, 0)]
