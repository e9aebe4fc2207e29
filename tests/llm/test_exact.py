import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.llm import exact

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, kind int"


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault((text or "").encode().lower(), []).append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        out += [(i, best, len(ids), i == best, hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [
    (1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, ""), (6, None), (7, "x" * 200_000), (8, "X" * 200_000),
    (9, "a b"), (9, "a b"), (None, "a b"), (None, "only"), (10, "K"), (11, "K"),
] + [(100 + i, "hot copy") for i in range(3000)]


@pytest.mark.parametrize("capacity", [exact.BUCKET_BYTES, 300_000, 200])
def test_groups(spark, capacity, monkeypatch):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # far smaller than a bucket's file
    monkeypatch.setattr(exact, "CHAIN_ROWS", 40)  # a hot copy comes from many flushes, so its bucket streams
    try:
        groups(spark, capacity)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def groups(spark, capacity):
    df = spark.createDataFrame([(i, t, None, None, None, "clash", 1) for i, t in ROWS], SCHEMA).repartition(5)
    got = exact.exact_groups(df, capacity).drop("_row").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_kept_rows(spark):
    df = spark.createDataFrame([(i, t, None, None, None, "clash", 1) for i, t in ROWS], SCHEMA)
    got = exact.kept_documents(df)
    assert got.columns == df.columns
    texts = [(r.text or "").encode().lower() for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").encode().lower() for _, t in ROWS})


def test_splits_double_the_directory(spark):
    """Every bucket is within its capacity or of one hash, and a split doubles the directory that knew it as one."""
    rows = [(i, f"text {i} " + "x" * (i % 50)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    entries = docs.mapInArrow(exact._entries, exact.ENTRY).where("kind = 0").select("hash", "entry", "id", "n", "text")
    total = sum(len(t) + exact.OVERHEAD for _, t in rows)
    capacity = -(-total // 32)
    small, large = exact.Directory(entries, capacity), exact.Directory(entries, 1 << 30)
    assert (large.slots, large.depth, large.buckets.count()) == (0, 0, 1)
    assert small.slots == 5 and small.depth > small.slots
    buckets = small.buckets.collect()
    assert max(b.bytes for b in buckets) <= capacity and {b.depth for b in buckets} > {small.slots}
    named = small.named(entries).select("hash", "bucket").collect()
    known = {b.start % 2**64: b.depth for b in buckets}
    for r in named:
        start, h = r.bucket % 2**64, r.hash % 2**64
        assert start <= h < start + (1 << (64 - known[start]))
    files = exact.write_buckets(entries, small, capacity)
    assert files.select("bucket", F.input_file_name()).distinct().groupBy("bucket").count().where("count > 1").count() == 0
    assert files.select("bucket").distinct().count() == len(buckets) and files.count() == 4000


def test_a_full_bucket_of_one_hash_streams(spark, monkeypatch):
    monkeypatch.setattr(exact, "CHAIN_ROWS", 10)
    docs = spark.createDataFrame([(i, "one text of very many rows") for i in range(5000)], "doc_id long, text string").repartition(4)
    (r,) = exact.exact_groups(docs, 300).select("keep_id", "group_size").distinct().collect()
    assert tuple(r) == (4999, 5000)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact.exact_groups(df).count() == 0 and exact.kept_documents(df).count() == 0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(50)]
    batches = exact._entries.__globals__["xxhash"]
    import pyarrow as pa

    monkeypatch.setattr(batches, "xxh64_intdigest", lambda text, seed: 5)
    class Context:
        partitionId = staticmethod(lambda: 0)
        get = staticmethod(lambda: Context)
    import pyspark
    monkeypatch.setattr(pyspark, "TaskContext", Context)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    entries, _ = list(exact._entries(iter([batch])))
    assert entries.num_rows == 7
    owner = pa.RecordBatch.from_arrays([entries.column(i) for i in (4, 1, 2, 3, 5)], names=["hash", "entry", "id", "n", "text"])
    twice = pa.Table.from_batches([owner, owner]).combine_chunks().to_batches()[0]
    (out,) = list(exact._merge(iter([twice])))
    assert out.num_rows == 14 and set(out.column(2).to_pylist()) == {14, 16}
