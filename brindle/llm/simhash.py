"""Operator 1: SimHash near-duplicates by multi-index hashing.

Fingerprints are taken per document; equal ones collapse to one, which carries the smallest id. Each
distinct fingerprint is in two tables, by its low and its high half. Two fingerprints within 3 bits differ
by at most 1 bit in one of the halves, so each looks up the ball of radius 1 around its half; of two halves
that differ by a bit one has it set, so only the 1 bits are cleared, which halves the look-ups. All that
meets in a cell is compared over all 64 bits. A cell gives links that span its groups, never all pairs:
at most a link for each fingerprint in it. A cell with many fingerprints is split by a second half of the
key, as follows. Members of one cell agree in 32 bits but for the looked-up bit, so what may still differ
is in the other half: it is cut into four bytes, one of which must then agree (3 differences, 4 bytes).
Cells still over the limit are compared block against block, each pair of blocks in a task of its own.

Defined results: null and empty texts and texts of blanks have fingerprint zero and link like any other;
a null doc_id counts as larger than all others (component_id null only if all of the group are null);
equal rows each give a row; an empty table gives an empty result; other columns are not read. A text of any
length is taken whole, its hashes a chunk at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, merged, raw, slices, table
from .components import components

WORDS, BITS, SEED = 3, 3, 42
#: Fingerprints in a cell beyond which it is split, and a block's when nothing else splits it.
CELL = 2048
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    w = (text or b"").lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(line, seed)
    lens = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    starts = np.zeros(len(w), dtype=np.int64)
    np.cumsum(lens[:-1] + 1, out=starts[1:])
    n = len(w) - words + 1
    s, e = starts[:n].tolist(), (starts + lens)[words - 1 :].tolist()
    sums = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _CHUNK):
        sums += _ones(np.array([digest(line[i:j], seed) for i, j in zip(s[k : k + _CHUNK], e[k : k + _CHUNK])], dtype=np.uint64))
    return _more_than_half(sums, n)


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _more_than_half(sums: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(sums * 2 > n, bitorder="little").tobytes(), "little")


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: the bits that are set in over half of them."""
    return _more_than_half(sum((_ones(h[k : k + _CHUNK]) for k in range(0, len(h), _CHUNK)), np.zeros(64, dtype=np.int64)), len(h))


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in slices(batches):
            f = np.array([fingerprint(x, words, seed) for x in raw(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], names=["doc_id", "fp"])

    return run


def _forest(f: np.ndarray, rep: np.ndarray, bits: int, other: int = 0) -> list[tuple[int, int]]:
    """Links that span the groups of f within so many bits; other > 0: only links from the first `other` to the rest."""
    n = len(f)
    up = np.arange(n)

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    rows = range(other) if other else range(n - 1)
    for i in rows:
        at = other if other else i + 1
        near = np.flatnonzero(np.bitwise_count(f[at:] ^ f[i]) <= bits) + at
        for j in near[up[near] != up[i]].tolist():
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(rep[i]), int(rep[j])))
    return out


def _link_cells(bits: int):
    """Rows in order of cell: links within each cell; a block pair's rows carry side 0 and 1."""

    def run(batches):
        held_key, held = None, []

        def flush():
            x = np.concatenate(held)
            f, rep, side = x["f"], x["rep"], x["side"]
            if side.any() and not side.all():
                order = np.argsort(side, kind="stable")
                return _forest(f[order], rep[order], bits, int((side == 0).sum()))
            return _forest(f, rep, bits)

        for batch in batches:
            key = np.asarray(batch.column(0))
            x = np.zeros(len(key), dtype=[("f", "u8"), ("rep", "i8"), ("side", "i1")])
            x["f"], x["rep"], x["side"] = np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2)), np.asarray(batch.column(3))
            cuts = np.flatnonzero(np.diff(key)) + 1
            links = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if lo == hi:
                    continue
                if held and key[lo] != held_key:
                    links += flush()
                    held = []
                held_key = key[lo]
                held.append(x[lo:hi])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if held and (links := flush()):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _split(over: DataFrame, cell: int) -> DataFrame:
    """Cells beyond the limit (cell, fp, rep) by a byte of what may still differ, and block against block where that is not enough."""
    other = F.when(F.shiftrightunsigned("cell", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    byte = F.posexplode(F.array(*[F.shiftrightunsigned(other, 8 * i).bitwiseAND(0xFF) for i in range(4)]))
    parts = over.select("cell", "fp", "rep", byte.alias("i", "v"))
    parts = parts.withColumn("key", F.xxhash64("cell", "i", "v"))
    count = parts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    parts = merged(parts).join(count.select(F.col("key").alias("k2"), "m"), F.col("key") == F.col("k2")).select("key", "fp", "rep", "m")
    medium = parts.where(F.col("m") <= cell).select("key", "fp", "rep", F.lit(0).cast("tinyint").alias("side"))
    blocks = F.ceil(F.col("m") / cell).cast("int")
    block = F.pmod(F.xxhash64("fp", F.lit(5)), blocks).cast("int")
    big = parts.where(F.col("m") > cell).withColumn("blocks", blocks).withColumn("block", block)
    big = big.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    big = big.select(
        F.xxhash64("key", F.least("block", "against"), F.greatest("block", "against")).alias("key"),
        "fp", "rep", F.expr("cast(block > against as tinyint)").alias("side"),
    )
    return medium.union(big)


def near_links(reps: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """(fp, rep), distinct fingerprints with an id each -> (a, b) ids, links that span every group within 3 bits."""
    if bits != 3:
        raise ValueError("two halves and radius 1 hold for 3 bits")
    halves = F.array(
        F.struct(F.lit(0).alias("s"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("v")),
        F.struct(F.lit(1).alias("s"), F.shiftrightunsigned("fp", 32).alias("v")),
    )
    probes = (
        reps.withColumn("h", F.explode(halves))
        .select("fp", "rep", "h.*", F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("bit"))
        .where("bit < 0 or getbit(v, bit) = 1")
        .select(
            "fp", "rep",
            F.expr("case when bit < 0 then v else v ^ shiftleft(1L, bit) end + shiftleft(cast(s as bigint), 32)").alias("cell"),
            F.expr("cast(bit < 0 as int)").alias("own"),
        )
    )
    # A cell matters if something lives in it and something else meets it there.
    sizes = probes.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 and own = 1")
    met = merged(probes).join(sizes.select(F.col("cell").alias("c2"), "n"), F.col("cell") == F.col("c2")).select("cell", "n", "fp", "rep")
    met = Kept(met, "cells").df
    small = met.where(F.col("n") <= cell).select(F.col("cell").alias("key"), "fp", "rep", F.lit(0).cast("tinyint").alias("side"))
    over = met.where(F.col("n") > cell)
    rows = small if over.isEmpty() else small.union(_split(over, cell))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link_cells(bits), "a long, b long")


def near_components(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (signed), component_id for every row."""
    prints = Kept(docs.select("doc_id", "text").mapInArrow(_fingerprints(words, seed), "doc_id long, fp long"), "prints").df
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    reps = Kept(prints.groupBy("fp").agg(F.min(last).alias("rep")), "reps").df
    # Nodes are fingerprints: ids can be null or repeated.
    found = components(near_links(reps.select("fp", F.col("fp").alias("rep")), bits))
    named = reps.join(found, reps["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    named = Kept(named, "named").df
    least = named.groupBy("c").agg(F.min("rep").alias("component_id")).withColumnRenamed("c", "c2")
    named = named.join(least, F.col("c") == F.col("c2")).select(F.col("fp").alias("fp2"), "component_id")
    return merged(prints).join(named, F.col("fp") == F.col("fp2")).select(
        "doc_id", "fp", F.nullif(F.col("component_id"), F.lit((1 << 63) - 1)).alias("component_id")
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
