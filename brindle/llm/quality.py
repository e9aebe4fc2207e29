"""Operator 10: a quality classifier by nearest-neighbour voting in a latent-semantic space.

A document is a bag of terms and marks, all hashed into FEATURES places: its words in lower case (ASCII) and the
4-grams of its bytes; trigrams of character classes with runs collapsed (lower, upper, digit, space, line end, each
sign for itself) and runs of one class by length; and three counters over the whole text: words that repeat the one
before, lines that were there before, and how many different words there are. Counts are damped, weighted by inverse
document frequency and projected by a truncated SVD; all of that is learned from a bounded sample of labelled rows
of the learning folds: at most SAMPLE for each label, those with the smallest hash of the id. The labelled
vectors (2 * SAMPLE * DIMS numbers: 1 MB) are broadcast. Every document's cosine with every labelled
vector is one block product; the K nearest vote with weight cosine ** POWER. Nothing but the text is an
input of a score.

Defined results: a null text scores as an empty one; without any label to learn from scores are 0.5, with
one label only they are that label; neighbours as near as the K-th (to 9 digits) all vote, so neither the order of
labelled rows nor that of documents matters, and equal texts score alike; labels with null doc_id or null label
teach nothing, and of several labels of one doc_id the smallest does; of several documents with one doc_id the text
with the smallest hash teaches; a null doc_id is not held out; an empty table gives an empty result; other columns
are not read. A text of any length is counted whole, a chunk at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, process_cache, raw, sent, slices, table

SAMPLE = 1024
DIMS = 64
K = 15
POWER = 8
FEATURES = 4096
#: Bytes of a text whose marks are counted at a time; counts add up over the whole text.
_CHUNK = 1 << 18
#: Places of class trigrams, words and byte 4-grams; the rest are for runs and counters.
_TRI, _WORDS, _GRAMS = 2048, 960, 1024
_EXTRA = FEATURES - _TRI - _WORDS - _GRAMS


def _classes() -> np.ndarray:
    c = np.zeros(256, dtype=np.int64)
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[[32, 9]] = 3
    c[[10, 13, 11, 12]] = 4
    for k, b in enumerate(b for b in range(33, 127) if not chr(b).isalnum()):
        c[b] = 5 + k
    c[[*range(0, 9), *range(14, 32), 127]] = 40
    return c


_CLASS = _classes()


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = 0x2545F4914F6CDD1D


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, made once in each process."""
    held = process_cache()
    if "powers" not in held:
        held["powers"] = tuple(
            np.multiply.accumulate(np.append(np.uint64(1), np.full(_CHUNK, np.uint64(x), dtype=np.uint64))) for x in (_ODD, pow(_ODD, -1, 1 << 64))
        )
    return held["powers"]


def _place(h: np.ndarray, size: int) -> np.ndarray:
    """Numbers of 64 bits -> places below size."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def _chunks(text: bytes):
    """Parts of at most _CHUNK bytes, cut behind white space where there is some."""
    start = 0
    while start < len(text):
        end = min(len(text), start + _CHUNK)
        if end < len(text):
            cut = max(text.rfind(b, start, end) for b in (b" ", b"\n"))
            end = cut + 1 if cut >= start else end
        yield np.frombuffer(text, dtype=np.uint8, offset=start, count=end - start)
        start = end


def _terms(a: np.ndarray, out: np.ndarray) -> None:
    """Words and 4-grams of bytes, added to out."""
    low, (up, down) = _LOWER[a], _powers()
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    s, e = edge[::2], edge[1::2]
    h = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((low + np.uint64(1)) * up[: len(low)])])
    out[_TRI : _TRI + _WORDS] += np.bincount(_place((h[e] - h[s]) * down[s], _WORDS), minlength=_WORDS)
    if len(a) >= 4:
        g = low[:-3] | low[1:-2] << np.uint64(8) | low[2:-1] << np.uint64(16) | low[3:] << np.uint64(24)
        out[_TRI + _WORDS : _TRI + _WORDS + _GRAMS] += np.bincount(_place(g, _GRAMS), minlength=_GRAMS)


def marks(text: bytes | None) -> np.ndarray:
    """Counts of the terms and marks of one text, FEATURES numbers."""
    text = text or b""
    out = np.zeros(FEATURES, dtype=np.float32)
    room = FEATURES - _EXTRA
    for a in _chunks(text):
        _terms(a, out)
        c = _CLASS[a]
        at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        r = np.concatenate([[4], c[at], [4]])
        grams = ((r[:-2] * 41 + r[1:-1]) * 41 + r[2:]) * 2654435761
        out[:_TRI] += np.bincount((grams >> 7) % _TRI, minlength=_TRI)
        runs = np.minimum(np.diff(np.append(at, len(c))), 15)
        long = runs[(c[at] > 0) & (runs > 1)]
        out[room : room + 16] += np.bincount(long, minlength=16)
    words = text.split()
    if words:
        n = len(words)
        again = sum(map(bytes.__eq__, words, words[1:]))
        lines = [x for x in text.split(b"\n") if x]
        seen = len(lines) - len(set(lines))
        out[room + 16] = 4 * again
        out[room + 17 + min(7, int(8 * again / n))] = n if again else 0
        out[room + 26] = 4 * seen
        out[room + 27 + min(7, int(8 * seen / len(lines)))] = n if seen else 0
        out[room + 36 + min(9, int(10 * len(set(words)) / n))] = n if n >= 20 else 0
        out[room + 47] = n
    else:
        out[room + 48] = 1
    return out


#: The counters' places, for those who want to see what the terms do without them.
COUNTERS = slice(FEATURES - _EXTRA + 16, FEATURES)


class Model:
    """Learned weights, projection, and the labelled vectors that vote."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dims: int = DIMS, k: int = K, power: int = POWER):
        # One order for the sample, however its rows came. The one copy of the counts is worked on in place.
        order = np.lexsort((np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in counts], dtype=np.uint64), labels))
        x, self.labels, self.k, self.power = counts[order].astype(np.float32, copy=False), labels[order].astype(np.float64), k, power
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        if len(x):
            x /= np.maximum(1, x.sum(axis=1, keepdims=True))
            np.sqrt(x, out=x)
            x *= self.idf
            x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
            values, vectors = np.linalg.eigh(x @ x.T)
            best = np.argsort(-values)[: min(dims, len(x))]
            best = best[values[best] > 1e-6]
            self.project = (x.T @ (vectors[:, best] / np.sqrt(values[best]))).astype(np.float32)
            self.vectors = self._unit(x @ self.project)

    @staticmethod
    def _damp(counts: np.ndarray) -> np.ndarray:
        share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True), dtype=np.float32)
        return np.sqrt(share, out=share)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if len(self.labels) == 0:
            return np.full(len(counts), 0.5)
        x = self._unit(self._unit(self._damp(counts) * self.idf) @ self.project)
        near = np.round(x.astype(np.float64) @ self.vectors.astype(np.float64).T, 9)
        k = min(self.k, near.shape[1])
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        weight = np.where(near >= least, np.maximum(1e-6, near) ** self.power, 0)
        return (weight @ self.labels) / weight.sum(axis=1)


def _sampled_marks(batches):
    for batch in slices(batches):
        rows = [marks(x) for x in raw(batch.column(0))]
        at = [np.flatnonzero(r) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(rows, at)], pa.list_(pa.float32()))],
            names=["label", "at", "n"],
        )


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` documents of each label, none of them of the held-out fold."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.where(fold(F.col("doc_id"), parts) != held_out).groupBy("doc_id").agg(F.min("label").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = [own.where(F.col("label") == x).orderBy(order, "doc_id").limit(sample) for x in (0, 1)]
    # At most 2 * sample ids, so this side can be broadcast; one row for each of them comes to the driver.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    picked = picked.withColumn("n", F.row_number().over(one)).where("n = 1").select("text", "label")
    rows = picked.mapInArrow(_sampled_marks, "label int, at array<int>, n array<float>").toArrow()
    counts = np.zeros((rows.num_rows, FEATURES), dtype=np.float32)
    for i, (at, n) in enumerate(zip(rows.column("at"), rows.column("n"))):
        counts[i, at.values.to_numpy()] = n.values.to_numpy()
    labels = rows.column("label").to_numpy().astype(np.float32)
    del rows
    return Model(counts, labels)


def score(docs: DataFrame, model: Model, parts: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    told = sent(docs.sparkSession, "quality", model)

    def run(batches):
        for batch in slices(batches, most=2 << 20):
            texts = raw(batch.column(1))
            s = np.concatenate([told().score(np.stack([marks(x) for x in texts[k : k + 256]])) for k in range(0, len(texts), 256)])
            s = np.clip(s, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are predicted to be good, with all their columns; no row is shuffled."""
    told = sent(docs.sparkSession, "quality", model)
    where = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, most=2 << 20):
            texts = raw(batch.column(where))
            s = np.concatenate([told().score(np.stack([marks(x) for x in texts[k : k + 256]])) for k in range(0, len(texts), 256)])
            yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
