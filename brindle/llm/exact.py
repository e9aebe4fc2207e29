"""Operator 2: exact duplicates by an extendible-hash index on shared files.

1. Each input task hashes its lower-cased texts (A-Z only) and chains rows whose hash collides; rows whose
   bytes are the same become one entry (text, its ids' largest, their number), so a text that a third of
   all rows hold leaves a task once. Entries and the (id, entry) members are files in the shared folder.
2. The directory has 2 ** depth slots, a slot for each prefix of the hash. It begins with as many as the entries'
   bytes ask for; then every overfull bucket is split by one more bit, which doubles the directory, until no
   bucket holds more than its capacity or only entries of one hash. Buckets are a table in the shared folder.
   Only overfull ones are counted again, and only sizes are read; the driver sees how many there are.
3. The directory names each entry's bucket, and each bucket becomes a file in the shared folder, in order of hash.
   The writers each take a range of slots.
4. Owner tasks read whole bucket files, each of them a range of hashes that no other task has: a file is one
   row group, which Spark never parts. An owner chains entries of one hash and compares bytes, with one chain
   in memory. A bucket that holds more than its capacity of one hash (copies from very many input tasks) streams
   through one owner. Members join their entry's verdict by the entry's number.

Defined results: null counts as the empty text; equal rows (one id twice) each give a row, and where the largest id
of a text has several rows they are all kept; a null id is smaller than any other; an empty table gives an empty
result; other columns are not read. A text of any length is one entry, compared whole; one above the capacity
has a bucket of its own.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, one_row_each, raw, slices, table

#: What a bucket holds at most, unless all its entries have one hash.
BUCKET_BYTES = 32 << 20
#: Counted for each entry besides its text; a bucket stays below 2 ** 20 entries, which one row group may hold.
OVERHEAD = 72
#: Tasks that write buckets at most; each takes a range of the directory's slots.
WRITERS = 1 << 16
#: Bytes of texts, and rows, that an input task chains before it lets its entries go.
CHAIN_BYTES, CHAIN_ROWS = 12 << 20, 50_000

ENTRY = "kind int, entry long, id long, n long, hash long, text binary, sha string"


def _signed(h: int) -> int:
    return h - ((h >> 63) << 64)


def _entries(batches):
    """Input rows -> kind 0: index entries with text; kind 1: members (id, entry). One pass, bounded memory."""
    serial = itertools.count()
    task = None

    def flush(chains, members):
        rows = [x for chain in chains.values() for x in chain]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([0] * len(rows), pa.int32()),
                pa.array([x[0] for x in rows], pa.int64()),
                pa.array([x[1] for x in rows], pa.int64()),
                pa.array([x[2] for x in rows], pa.int64()),
                pa.array([x[3] for x in rows], pa.int64()),
                pa.array([x[4] for x in rows], pa.binary()),
                pa.array([x[5] for x in rows], pa.string()),
            ],
            names=["kind", "entry", "id", "n", "hash", "text", "sha"],
        )
        none = pa.nulls(len(members))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([1] * len(members), pa.int32()),
                pa.array([m[1] for m in members], pa.int64()),
                pa.array([m[0] for m in members], pa.int64()),
                none.cast(pa.int64()),
                pa.array([m[3] for m in members], pa.int64()),
                none.cast(pa.binary()),
                pa.array([m[2] for m in members], pa.string()),
            ],
            names=["kind", "entry", "id", "n", "hash", "text", "sha"],
        )

    chains, members, held = {}, [], 0
    for batch in slices(batches):
        if task is None:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId() << 34
        for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            as_it_is = 42 if text is None else _signed(xxhash.xxh64_intdigest(text, 42))
            text = (text or b"").lower()
            h = _signed(xxhash.xxh64_intdigest(text, 11))
            chain = chains.setdefault(h, [])
            for x in chain:
                if x[4] == text:
                    x[2] += 1
                    if doc is not None and (x[1] is None or doc > x[1]):
                        x[1] = doc
                    break
            else:
                x = [task | next(serial), doc, 1, h, text, hashlib.sha256(text).hexdigest()]
                chain.append(x)
                held += len(text) + 400
            members.append((doc, x[0], x[5], as_it_is))
        if held > CHAIN_BYTES or len(members) > CHAIN_ROWS:
            yield from flush(chains, members)
            chains, members, held = {}, [], 0
    if members:
        yield from flush(chains, members)


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


def _ordered(hash_: Column) -> Column:
    """Signed numbers in the order of the unsigned hashes."""
    return hash_.bitwiseXOR(F.lit(-(1 << 63)))


class Directory:
    """`slots` bits name a slot at first and `depth` after all splits; buckets: first hash, depth, bytes, whether of one hash."""

    def __init__(self, entries: DataFrame, capacity: int):
        total = entries.agg(F.sum(_size())).first()[0] or 0
        self.slots = self.depth = max(0, -(-total // capacity) - 1).bit_length()
        left = entries.select("hash", _size().alias("size"))
        found = []
        while True:
            p = _prefix(self.depth).alias("p")
            held = left.groupBy(p).agg(F.sum("size").alias("bytes"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
            start = F.shiftleft("p", 64 - self.depth) if self.depth else F.lit(0).cast("long")
            held = held.select("p", start.alias("start"), F.lit(self.depth).alias("depth"), "bytes", (F.col("lo") == F.col("hi")).alias("one"))
            held = Kept(held.withColumn("over", F.col("bytes") > capacity), "buckets").df
            found.append(held.where("one or not over"))
            full = held.where("over and not one").select(F.col("p").alias("q"))
            if full.isEmpty():
                break
            left = left.join(full, _prefix(self.depth) == F.col("q"), "left_semi")
            self.depth += 1
        self.buckets = reduce(DataFrame.union, found).select("start", "depth", "bytes", "one", (F.col("one") & F.col("over")).alias("streams"))

    def named(self, entries: DataFrame) -> DataFrame:
        """The entries with slot, bucket (its first hash) and whether it streams."""
        slot = _prefix(self.slots)
        of = F.shiftrightunsigned("start", 64 - self.slots) if self.slots else F.lit(0).cast("long")
        # Slots that are one bucket need no row, so this table is small where few were split; Spark joins by its size.
        leaves = self.buckets.where((F.col("depth") > self.slots) | F.col("streams")).groupBy(of.alias("_slot"))
        leaves = Kept(leaves.agg(F.collect_list(F.struct(_ordered(F.col("start")).alias("at"), "streams")).alias("leaves")), "splits").df
        mine = F.array_max(F.filter("leaves", lambda x: x["at"] <= _ordered(F.col("hash"))))
        whole = F.shiftleft(slot, 64 - self.slots) if self.slots else F.lit(0).cast("long")
        return (
            entries.withColumn("slot", slot)
            .join(leaves, F.col("slot") == F.col("_slot"), "left")
            .withColumn("bucket", F.when(F.col("leaves").isNull(), whole).otherwise(_ordered(mine["at"])))
            .withColumn("streams", F.coalesce(mine["streams"], F.lit(False)))
        )


def _size() -> Column:
    return F.length("text") + OVERHEAD


def _merge(batches):
    """An owner task: entries in hash order; chains of one hash are compared byte by byte."""
    chain: list[list] = []
    at = None

    def verdicts():
        rows = [(e, x[1], x[2]) for x in chain for e in x[3]]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["entry", "keep_id", "group_size"]
        )

    for batch in slices(batches):
        cols = [batch.column(i).to_pylist() for i in range(5)]
        out = []
        for h, entry, doc, n, text in zip(*cols):
            if h != at:
                if chain:
                    out.append(verdicts())
                at, chain = h, []
            for x in chain:
                if x[0] == text:
                    x[2] += n
                    x[3].append(entry)
                    if doc is not None and (x[1] is None or doc > x[1]):
                        x[1] = doc
                    break
            else:
                chain.append([text, doc, n, [entry]])
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if chain:
        yield verdicts()


def write_buckets(entries: DataFrame, directory: Directory, capacity: int) -> DataFrame:
    """A file for each bucket in the shared folder, in order of hash, as one row group."""
    writers = min(1 << directory.slots, WRITERS)
    range_of = F.shiftright("slot", directory.slots - (writers.bit_length() - 1)).cast("int")
    cols = ["hash", "entry", "id", "n", "text", "streams", "bucket"]
    named = directory.named(entries).repartitionById(writers, range_of).select(*cols).sortWithinPartitions("streams", "bucket", "hash")
    return Kept(named, "bucket-files", by=["streams", "bucket"], **{"parquet.block.size": str(max(16 * capacity, 1 << 20))}).df


def exact_groups(docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and _row, xxhash64 of the text as it is."""
    index = Kept(docs.select("doc_id", "text").mapInArrow(_entries, ENTRY), "exact-index")
    entries = index.df.where("kind = 0").select("hash", "entry", "id", "n", "text")
    buckets = write_buckets(entries, Directory(entries, capacity), capacity)
    verdict = "entry long, keep_id long, group_size long"
    cols = ["hash", "entry", "id", "n", "text"]
    verdicts = buckets.where("not streams").select(*cols).mapInArrow(_merge, verdict)
    long = buckets.where("streams")
    if not long.isEmpty():
        verdicts = verdicts.union(long.repartition("bucket").sortWithinPartitions("hash").select(*cols).mapInArrow(_merge, verdict))
    members = index.df.where("kind = 1").select("id", "entry", "sha", "hash")
    return members.join(verdicts, "entry").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("hash").alias("_row"),
    )


def kept_documents(docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """The documents that stay, with all their columns; of rows with one id and equal texts, one."""
    with Kept.passing() as tables:
        found = exact_groups(docs, capacity).select(F.col("doc_id").alias("_id"), "_row", "kept", F.unhex("text_sha256").alias("sha"))
        found = Kept(found, "verdicts")
        tables.remove(found)
    found = found.df
    one = found.where("kept").groupBy("_id", "sha").agg(F.min("_row").alias("_key"), F.count("*").alias("n")).where("n > 1")
    one = Kept(one, "repeated").df
    # Of rows that share id and text the one with the smallest hash of the text as it is, once.
    rows = one.select(F.col("_id").alias("i2"), F.col("sha").alias("s2"), F.col("_key").alias("stays"))
    rows = found.where("kept").join(rows, F.col("_id").eqNullSafe(F.col("i2")) & (F.col("sha") == F.col("s2"))).where("_row <> stays")
    gone = found.where("not kept").select("_id", F.col("_row").alias("_key")).union(rows.select("_id", "_row"))
    return one_row_each(docs, gone, one)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("_row")


SQL = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as s
  from documents)
select doc_id, max(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
  doc_id = max(doc_id) over (partition by s) as kept, s as text_sha256
from t
"""
