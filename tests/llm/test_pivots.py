import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from brindle.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, v string, norm string"


def brute(rows, k=10, every=10):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(1024.0 * x) for x in v):
            usable.append((i, [math.floor(1024.0 * x) for x in v]))
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        asks = min((v for i, v in usable if i == q), key=lambda v: struct.pack(f"<{len(v)}d", *v))
        scored = sorted((-sum(a * b for a, b in zip(asks, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def rows_for(seed):
    import numpy as np

    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [f32(c + rng.gauss(0, 0.2)) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(510, []), (520, [1.0, 2.0]), (530, [0.25] * 12), (540, [0.0] * 8), (7, rows[7][1]), (20, [0.125] * 8)]
    return rows


@pytest.mark.parametrize("seed,pivot_n", [(1, 32), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, pivot_n):
    monkeypatch.setattr(pivots, "PIVOTS", pivot_n)
    monkeypatch.setattr(pivots, "QUERIES", 12)
    rows = rows_for(seed)
    df = spark.createDataFrame([(a, b, 0, "clash", "clash") for a, b in rows], SCHEMA).repartition(4)
    got = pivots.top_products(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_large_numbers_stay_exact(spark):
    """Products far above 2^53, components above it, and one that the scale makes infinite."""
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(-(10**6), 10**6)) for _ in range(4)]) for i in range(40)]
    rows += [(50, [1e300 * 1e7, -1e300, 0.0, 1.0]), (60, [0.0, 1e13, 0.0, -2.0**-10]), (61, [1e13, 2.0**-9, 0.0, 0.0]), (62, [1e13, 2.0**-10, 0.0, 0.0])]
    small = [(i, v if i >= 50 else [x / 1e4 for x in v]) for i, v in rows]
    for r in (rows[:41], small):
        df = spark.createDataFrame(r, "vec_id long, embedding array<double>")
        if any(abs(s) >= 1 << 63 for *_, s in brute(r, k=3)):
            with pytest.raises(Exception, match="beyond 64 bits"):
                pivots.top_products(df, F.col("vec_id") % 10 == 0, k=3).collect()
            continue
        got = pivots.top_products(df, F.col("vec_id") % 10 == 0, k=3).collect()
        assert sorted(map(tuple, got)) == brute(r, k=3)


def test_products_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e14]), (1, [1e14]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        pivots.top_products(df, F.col("vec_id") % 10 == 0).collect()


def test_many_blocks_and_parts(spark, monkeypatch):
    """Blocks of queries by nearest pivot, several parts each, most vectors kept from most blocks; against numpy."""
    import numpy as np

    monkeypatch.setattr(pivots, "QUERIES", 64)
    monkeypatch.setattr(pivots, "PART", (500, 4000))
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 3, (12, 16))
    x = (centres[rng.integers(0, 12, 20_000)] + rng.normal(0, 0.3, (20_000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    got = sorted(map(tuple, pivots.top_products(df, F.col("vec_id") % 20 == 0).collect()))
    whole = np.floor(1024.0 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 20_000, 20):
        s = whole @ whole[q]
        s[q] = np.iinfo(np.int64).min
        best = [b for b in np.lexsort((np.arange(len(s)), -s.astype(np.float64)))[:11].tolist() if b != q][:10]
        want += [(q, r + 1, b, int(s[b])) for r, b in enumerate(best)]
    assert got == sorted(want)


def test_empty_and_alone(spark):
    assert pivots.top_products(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 0, "", "")], SCHEMA)
    assert pivots.top_products(alone, F.col("vec_id") % 10 == 0).count() == 0
