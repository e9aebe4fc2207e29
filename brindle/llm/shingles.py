"""Near-duplicates by the Jaccard similarity of their sets of 5-word shingles: every pair of 0.8 or more.

Operator 1 carried to that similarity. Two texts whose sets share 0.8 of their union differ in about 10 of 64
fingerprint bits, sometimes in 20, and balls of such a radius hold most of the table; so fingerprints alone can't
find all of these pairs. They find what lies within 3 bits: SimHash over the sets, multi-index hashing, at most a
link for each member of a group.

That is completed by an exact set-similarity join with prefixes. All shingles are put in one order; two sets of
similarity s or more share at least s of the larger one, so they share a shingle among the first n - ceil(s n) + 1
of each. Only these go to cells, one for each shingle. The order puts shingles that are frequent in a sample last,
which keeps cells small; it changes the speed only. What meets in a cell is compared in three rounds, so that a group
of m near copies costs about m comparisons and not m squared: first each member with the cell's first one; then, of
the pairs of different components that a bound leaves, those that would span the cell; then all pairs of what is still
apart, which the bound leaves few of. The bound rules out most pairs before whole sets travel: parities of the
shingles' hashes, over at least twice as many bits as shingles, differ in no more bits than the sets differ in
shingles. Each pair that is left is verified with both whole sets, so no pair is missed and none is linked that is
less similar.

Defined results: texts are compared by words in lower case (ASCII); fewer than five words are one shingle, no
words (null, empty, blanks) are one set; a null doc_id counts as larger than all others; of equal rows one
stays if they do; an empty table gives an empty result. A text of any length is compared by its whole set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, merged, one_row_each, raw, slices
from .components import components
from .simhash import majority, near_links

#: Similar are sets that share OF / PER of their union or more.
WORDS, OF, PER, SEED = 5, 4, 5, 42
#: Members of a cell beyond which it is compared block against block.
CELL = 2048
#: For the order only: documents in the sample, shingles put last, the count from which one is.
SAMPLE, LAST, OFTEN = 10_000, 1 << 16, 3
#: Parities of a set at least; a power of two.
BITS = 1024
_PAIRS = 1 << 16


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's shingles, sorted, each once."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(1, dtype=np.uint64)
    line = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.unique(np.array([digest(line[i:j], SEED) for i, j in spans], dtype=np.uint64))


def prefix(s: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(OF n / PER) + 1 of n shingles: by hash, then those in last (sorted) by rank."""
    n = len(s)
    most = n + (-OF * n // PER) + 1
    if not len(last):
        return s[:most]
    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
    late = last[at] == s
    return np.concatenate([s[~late], s[late][np.argsort(rank[at[late]])]])[:most]


def parities(s: np.ndarray) -> np.ndarray:
    """At least 2 bits a shingle, BITS or more, in words of 64; each shingle turns the bit that its lowest bits name.

    So the halves of a longer list, put together by exclusive or, are the list of half the length.
    """
    size = max(BITS, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    """A list of parities, cut down to BITS of them."""
    return np.bitwise_xor.reduce(bits.reshape(-1, BITS // 64), axis=0)


def _half(x: Column) -> Column:
    n = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda a, b: a.bitwiseXOR(b))


def _apart(x: Column, y: Column) -> Column:
    """In how many bits two lists differ, the longer one cut to the other (sizes of pairs are within a quarter)."""
    x, y = F.when(F.size(x) > F.size(y), _half(x)).otherwise(x), F.when(F.size(y) > F.size(x), _half(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def _sampled(words: int):
    def run(batches):
        for batch in slices(batches):
            found = np.concatenate([shingles(x, words) for x in raw(batch.column(0))] or [np.zeros(0, dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

    return run


def _prints(words: int, last: np.ndarray, rank: np.ndarray):
    def run(batches):
        for batch in slices(batches):
            sig, fp, size, bits, keys = [], [], [], [], []
            for x in raw(batch.column(2)):
                s = shingles(x, words)
                sig.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                fp.append(majority(s))
                size.append(len(s))
                bits.append(parities(s))
                keys.append(prefix(s, last, rank).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            cols = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (sig, fp)]
            cols.append(pa.array(size, pa.int32()))
            cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bits)]).astype(np.int32)), pa.array(np.concatenate(bits))))
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "tkey", "sig", "fp", "size", "bits", "keys"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in slices(batches):
            found = [shingles(x, words).tobytes() for x in raw(batch.column(0))]
            sig = np.array([xxhash.xxh64_intdigest(x, SEED) for x in found], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(found, pa.binary())], names=["sig", "own"])

    return run


def _verified(batches):
    """Pairs with both sets -> those that are similar."""
    for batch in batches:
        a, b, x, y = (batch.column(k) for k in range(4))
        yes = []
        for p, q in zip(x, y):
            p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (p, q))
            shared = len(np.intersect1d(p, q, assume_unique=True))
            yes.append(PER * shared >= OF * (len(p) + len(q) - shared))
        yes = pa.array(yes, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(yes), b.filter(yes)], names=["a", "b"])


def _across(spanning: bool):
    """Rows in order of cell -> pairs in different components that may be similar; a block pair's rows carry side 0 and 1.

    Spanning: only pairs that would join what the cell's pairs before have not, at most one for each member.
    """
    return lambda batches: _pairs_of_cells(batches, spanning)


def _pairs_of_cells(batches, spanning: bool):
    held_key, held, seen = None, [], set()

    def flush():
        x = np.concatenate(held)
        two = x["side"].any() and not x["side"].all()
        x = x[np.argsort(x["side"], kind="stable")]
        other = int((x["side"] == 0).sum()) if two else 0
        up: dict[int, int] = {}

        def root(c):
            while up.get(c, c) != c:
                up[c] = up.get(up[c], up[c])
                c = up[c]
            return c

        for i in range(other or len(x) - 1):
            y = x[other or i + 1 :]
            y = y[y["comp"] != x["comp"][i]]
            if x["first"][i]:
                continue
            y = y[(y["first"] == 0) & (OF * np.maximum(y["size"], x["size"][i]) <= PER * np.minimum(y["size"], x["size"][i]))]
            apart = np.bitwise_count(y["bits"] ^ x["bits"][i]).sum(axis=1, dtype=np.int64)
            y = y[(OF + PER) * apart <= (PER - OF) * (y["size"] + x["size"][i])]
            s = int(x["sig"][i])
            if not spanning:
                seen.update((min(s, t), max(s, t)) for t in y["sig"].tolist())
                continue
            for t, c in zip(y["sig"].tolist(), y["comp"].tolist()):
                a, b = root(int(x["comp"][i])), root(c)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    seen.add((min(s, t), max(s, t)))

    def out():
        rows = sorted(seen)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        col = {n: np.asarray(batch.column(k)) for k, n in enumerate(batch.schema.names) if n != "bits"}
        key = col["key"]
        x = np.zeros(len(key), dtype=[("sig", "i8"), ("comp", "i8"), ("size", "i8"), ("first", "i1"), ("side", "i1"), ("bits", "u8", BITS // 64)])
        for n in ("sig", "comp", "size", "first", "side"):
            x[n] = col[n]
        bits = batch.column(batch.schema.get_field_index("bits"))
        for k, (lo, hi) in enumerate(zip(bits.offsets[:-1].to_pylist(), bits.offsets[1:].to_pylist())):
            x["bits"][k] = folded(np.asarray(bits.values[lo:hi])).view(np.uint64)
        cuts = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if lo == hi:
                continue
            if held and key[lo] != held_key:
                flush()
                held = []
                if len(seen) >= _PAIRS:
                    yield out()
            held_key = key[lo]
            held.append(x[lo:hi])
    if held:
        flush()
    yield out()


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample, sorted, and the rank of each by its count."""
    part = max(1, docs.count() // SAMPLE)
    found = docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text").mapInArrow(_sampled(words), "key long")
    found = found.groupBy("key").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(LAST).collect()
    last = np.array([r.key for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(last)
    return last[order], -order


def _groups(docs: DataFrame, words: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, sig of every row), (sig, rep, n rows, component of every set)."""
    last, rank = _frequent(docs, words)
    prints = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(
        _prints(words, last, rank), "doc_id long, tkey long, sig long, fp long, size int, bits array<long>, keys array<long>"
    )
    prints = Kept(prints, "set-prints").df
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("rep")
    same = [F.first(c).alias(c) for c in ("fp", "size", "bits")]
    reps = Kept(prints.groupBy("sig").agg(rep, F.count("*").alias("n"), *same), "reps").df
    # What lies within the fingerprints' bits, by multi-index hashing.
    fps = Kept(reps.groupBy("fp").agg(F.min("sig").alias("rep")), "fps").df
    own = fps.select(F.col("fp").alias("fp2"), F.col("rep").alias("a"))
    equal = reps.select("fp", F.col("sig").alias("b")).join(own, F.col("fp") == F.col("fp2")).where("a <> b").select("a", "b")
    pairs = near_links(fps, cell=cell).union(equal)
    # What meets in cells, each with the cell's first. Rows with one set meet again; pairs take no notice of how often a set is there.
    probes = prints.select("sig", F.explode("keys").alias("key"))
    sizes = probes.groupBy("key").agg(F.count("*").alias("m"), F.min("sig").alias("first"), F.max("sig").alias("last"))
    sizes = sizes.where("first < last").select(F.col("key").alias("k2"), "m", "first")
    met = Kept(merged(probes).join(sizes, F.col("key") == F.col("k2")).select("key", "m", "first", "sig"), "cells").df
    pairs = pairs.union(met.where("sig <> first").select("first", "sig")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _similar(docs, reps, pairs, words)
    found = Kept(components(links), "components").df
    # Cells of three or more that the links left apart: pairs that would span them, then all pairs of what is still apart.
    for spanning in (True, False):
        left = met.where("m > 2").join(found, F.col("sig") == F.col("node"), "left")
        left = Kept(left.select("key", "m", "first", "sig", F.coalesce("component", "sig").alias("comp")), "left").df
        apart = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("key").alias("k2"))
        apart = Kept(apart, "apart").df
        if apart.isEmpty():
            break
        left = left.join(apart, F.col("key") == F.col("k2"), "left_semi")
        more = _similar(docs, reps, _pairs_across(left, reps, cell, spanning), words)
        if not more.isEmpty():
            links = links.union(more)
            found = Kept(components(links), "components").df
    named = reps.join(found, F.col("sig") == F.col("node"), "left").select("sig", "rep", "n", F.coalesce("component", "sig").alias("component"))
    return prints.select("doc_id", "tkey", "sig"), named


def _pairs_across(left: DataFrame, reps: DataFrame, cell: int, spanning: bool) -> DataFrame:
    """Members of cells (key, m, first, sig, comp) -> pairs of different components, cells beyond `cell` block against block."""
    left = left.join(merged(reps).select(F.col("sig").alias("s2"), "size", "bits"), F.col("sig") == F.col("s2"))
    left = left.withColumn("blocks", F.ceil(F.col("m") / cell).cast("int")).withColumn("block", F.pmod(F.xxhash64("sig", F.lit(5)), F.col("blocks")).cast("int"))
    left = left.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select(
        F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "against"), F.greatest("block", "against"))).alias("key"),
        "sig", "comp", "size", (F.col("sig") == F.col("first")).cast("tinyint").alias("first"),
        F.expr("cast(block > against as tinyint)").alias("side"), "bits",
    )
    return left.repartition("key").sortWithinPartitions("key").mapInArrow(_across(spanning), "a long, b long").distinct()


def near_components(docs: DataFrame, words: int = WORDS, cell: int = CELL) -> DataFrame:
    """For each set of shingles: sig, rep (no_id, doc_id, tkey: the smallest id and the hash of its text), n rows, component."""
    return _groups(docs, words, cell)[1]


def _similar(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Pairs whose sizes and parities allow it and whose whole sets are similar; the sets are made again, of those texts only."""
    side = lambda n: merged(reps).select(F.col("sig").alias(f"s{n}"), F.col("size").alias(f"n{n}"), F.col("bits").alias(f"b{n}"))
    pairs = pairs.join(side(1), F.col("a") == F.col("s1")).join(side(2), F.col("b") == F.col("s2"))
    pairs = pairs.where(F.greatest("n1", "n2") * OF <= F.least("n1", "n2") * PER)
    pairs = pairs.where((OF + PER) * _apart(F.col("b1"), F.col("b2")) <= (PER - OF) * (F.col("n1") + F.col("n2")))
    pairs = Kept(pairs.select("a", "b"), "pairs").df
    if pairs.isEmpty():
        return pairs
    need = pairs.select("a").union(pairs.select("b")).distinct()
    # Kept, so that its size is known: texts are met by broadcast where these hashes are few, else by a shuffle.
    texts = Kept(reps.join(need, F.col("sig") == F.col("a"), "left_semi").select(F.col("rep.tkey").alias("_tkey")).distinct(), "texts").df
    texts = docs.select("text").join(texts, F.xxhash64("text") == F.col("_tkey"), "left_semi")
    sets = Kept(texts.mapInArrow(_sets(words), "sig long, own binary").dropDuplicates(["sig"]), "sets").df
    x, y = (merged(sets).select(F.col("sig").alias(f"s{n}"), F.col("own").alias(n)) for n in "xy")
    both = pairs.join(x, F.col("a") == F.col("sx")).join(y, F.col("b") == F.col("sy")).select("a", "b", "x", "y")
    return Kept(both.mapInArrow(_verified, "a long, b long"), "similar").df


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, with all its columns."""
    with Kept.passing() as tables:
        prints, named = _groups(docs, words, CELL)
        keep = named.groupBy("component").agg(F.min("rep").alias("r"), F.sum("n").alias("rows")).where("rows > 1")
        keep = keep.select(F.col("component").alias("c2"), F.col("r.doc_id").alias("keep_id"), F.col("r.tkey").alias("keep_key"))
        keep = named.join(keep, F.col("component") == F.col("c2")).select(F.col("sig").alias("s2"), "keep_id", "keep_key")
        met = merged(prints).join(keep, F.col("sig") == F.col("s2")).select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), "keep_id", "keep_key")
        stays = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_key") == F.col("keep_key"))
        met = Kept(met.groupBy("_id", "_key", stays.alias("stays")).count(), "met")
        tables.remove(met)
    met = met.df
    return one_row_each(docs, met.where("not stays"), met.where("stays and count > 1"))
