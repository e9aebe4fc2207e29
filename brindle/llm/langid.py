"""Operator 8: language identification by a linear-chain conditional random field over words.

A word is a run of letters. Its features are its first and last 2 and 3 bytes (affixes), its byte bigrams and
trigrams with the blanks around it, and itself (a learned lexicon), all hashed; transitions between the
languages of neighbouring words are learned with them. Training takes a bounded number of rows: for each language
the DOCS documents with the smallest hash of the id, each with its whole text (a text of a hundred MB that is among
them is learned from whole, so the driver must hold it). Texts are parted into stretches of STRETCH words, and
those of all languages are joined in random order, so that the field sees code-switched text. It is fitted by
gradient ascent on the exact conditional likelihood (forward-backward), some sequences at a time.

A prediction runs forward-backward over all words of a text, exact for any length, and gives each word the language
with the highest marginal probability (`label_words`); averaged over the words, the marginals name the text's
language, and its average is the score (`identify`).

Defined results: `und` and score 0 for a null text, for one without a letter, and where nothing could be
learned, and no words; languages are the non-null values of lang; of languages with equal probability the first by
code points; a null doc_id is not held out and does not teach; of several rows with one doc_id and language the text
with the smallest hash teaches; equal rows get equal results; an empty table gives an empty result; other columns
are not read. A long text is held by its task: some 50 bytes for each word and language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, fold, raw, sent, slices, table

DOCS = 100
STRETCH = 25
SEQUENCE = 64
EPOCHS = 40
UNKNOWN = "und"
_TRI, _AFFIX, _WORD = 1 << 17, 1 << 16, 1 << 18
_BYTES = 1 << 19
#: Words whose expectations are taken at a time while fitting; a multiple of SEQUENCE.
_PART = 1 << 15


def _lower_table() -> np.ndarray:
    """ASCII letters in lower case, all other ASCII as a blank, other bytes as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    for c in range(ord("a"), ord("z") + 1):
        t[c] = t[c - 32] = c
    return t


_LOWER = _lower_table()


def normal(text: bytes) -> np.ndarray:
    a = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    if len(a) > 1:
        # Capitals U+00C0 to U+00DE become U+00E0 to U+00FE.
        second = np.flatnonzero((a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97)) + 1
        a[second] += 0x20
    return a


def words_in(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; `a` begins and ends with a blank."""
    letter = a != 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    return edge[::2], edge[1::2]


def _hash(x: np.ndarray, size: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def features(a: np.ndarray, s: np.ndarray, e: np.ndarray):
    """For each byte its bigram and trigram; for each word the rows of affixes and lexicon."""
    x = a.astype(np.int64)
    bi = x[:-1] * 256 + x[1:]
    tri = _hash(bi[:-1] * 256 + x[2:], _TRI)
    bi = bi[:-1]
    p = np.append(x, [32, 32, 32])
    pre2, suf2 = p[s] * 256 + p[s + 1], p[e - 2] * 256 + p[e - 1]
    pre3, suf3 = pre2 * 256 + p[s + 2], p[e - 3] * 65536 + suf2
    affixes = [_hash(k * 4 + v, _AFFIX) for k, v in ((pre2, 0), (pre3, 1), (suf2, 2), (suf3, 3))]
    powers = np.multiply.accumulate(np.full(len(x) + 1, np.uint64(0x2545F4914F6CDD1D), dtype=np.uint64))
    h = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x.astype(np.uint64) * powers[:-1])])
    inverse = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
    down = np.multiply.accumulate(np.full(len(x) + 1, inverse, dtype=np.uint64))
    word = _hash((h[e] - h[s]) * down[s], _WORD)
    return bi, tri, np.stack([*affixes, word + _AFFIX], axis=1)


def forward_backward(psi: np.ndarray, transitions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, start: np.ndarray):
    """Marginals of every position of many chains at once; chains lie one behind the other in psi.

    Returns alpha and beta, scaled to sum 1 at each position, and the log of the partition functions' sum.
    Chains go in order of length, so each step works on those that are still running.
    """
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    alpha, beta = np.empty_like(psi), np.empty_like(psi)
    running = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")
    total = 0.0
    last = None
    for t in range(int(n[0]) if len(n) else 0):
        at = s[: running[t]] + t
        x = (last[: running[t]] @ transitions if t else start) * psi[at]
        z = x.sum(axis=1, keepdims=True)
        total += float(np.log(z).sum())
        last = x / z
        alpha[at] = last
    size = psi.shape[1]
    later = np.zeros((0, size), dtype=psi.dtype)
    for t in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
        at = s[: running[t]] + t
        x = np.full((running[t], size), 1.0 / size, dtype=psi.dtype)
        if len(later):
            x[: len(later)] = later @ transitions.T
        x /= x.sum(axis=1, keepdims=True)
        beta[at] = x
        later = x * psi[at]
    return alpha, beta, total


class Model:
    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs = langs
        self.bi = np.zeros((65536, n), dtype=np.float32)
        self.tri = np.zeros((_TRI, n), dtype=np.float32)
        self.own = np.zeros((_AFFIX + _WORD, n), dtype=np.float32)
        self.transitions = np.zeros((n, n))
        self.start = np.zeros(n)

    def potentials(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the words' scores, scaled to a largest of 1, and the words' first bytes; bounded work at a time."""
        s, e = words_in(a)
        out = np.empty((len(s), len(self.langs)))
        lo = 0
        while lo < len(s):
            hi = max(lo + 1, int(np.searchsorted(e, s[lo] + _BYTES, side="right")))
            base = s[lo] - 1
            part = a[base : e[hi - 1] + 2]
            if len(part) < e[hi - 1] - base + 2:
                part = np.append(part, np.uint8(32))
            bi, tri, own = features(part, s[lo:hi] - base, e[lo:hi] - base)
            grams = np.zeros((len(bi) + 1, len(self.langs)))
            np.cumsum(self.bi[bi] + self.tri[tri], axis=0, out=grams[1:], dtype=np.float64)
            w = grams[e[lo:hi] - base] - grams[s[lo:hi] - base - 1]
            w += self.own[own].sum(axis=1)
            out[lo:hi] = w
            lo = hi
        out -= out.max(axis=1, keepdims=True, initial=-np.inf)
        return np.exp(np.maximum(out, -50)), s

    def marginals(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts' words: probabilities, first bytes and ends (in their texts); of texts: first words and numbers of words."""
        lens = np.array([len(t or b"") for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(lens + 1)])[:-1] + 1
        a = np.append(np.uint8(32), normal(b" ".join(t or b"" for t in texts) + b" "))
        psi, first = self.potentials(a)
        ends = words_in(a)[1]
        starts = np.searchsorted(first, begin)
        lengths = np.diff(np.append(starts, len(first)))
        some = np.flatnonzero(lengths)
        alpha, beta, _ = forward_backward(psi, np.exp(self.transitions), starts[some], lengths[some], np.exp(self.start))
        alpha *= beta
        alpha /= alpha.sum(axis=1, keepdims=True)
        base = np.repeat(begin, lengths)
        return alpha, first - base, ends - base, starts, lengths

    @staticmethod
    def speaks(text: bytes) -> bool:
        """Whether a text with words has a letter: some signs beyond ASCII are none."""
        return text.isascii() or any(c.isalpha() for c in text.decode("utf-8", "replace"))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        p, _, _, starts, lengths = self.marginals(texts)
        some = np.flatnonzero(lengths)
        if not len(some):
            return langs, scores
        mean = np.add.reduceat(p, starts[some], axis=0) / lengths[some][:, None]
        best = mean.argmax(axis=1)
        for i, k, m in zip(some.tolist(), best.tolist(), mean):
            if self.speaks(texts[i]):
                langs[i], scores[i] = self.langs[k], min(1.0, float(m[k]))
        return langs, scores


def fit(samples: list[tuple[str, bytes]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4, seed: int = 1) -> Model:
    """(language, stretch of text): joined in random order, cut into sequences, fitted by Adagrad."""
    model = Model(sorted({lang for lang, _ in samples}, key=lambda s: s.encode()))
    if len(model.langs) == 0:
        return model
    rng = np.random.default_rng(seed)
    samples = [samples[i] for i in rng.permutation(len(samples))]
    number = {lang: k for k, lang in enumerate(model.langs)}
    a = np.append(np.uint8(32), normal(b" ".join(t for _, t in samples) + b"  "))
    s, e = words_in(a)
    if not len(s):
        return Model([])
    ends = np.cumsum([len(t) + 1 for _, t in samples])
    gold = np.array([number[lang] for lang, _ in samples])[np.searchsorted(ends, s - 1, side="right").clip(max=len(samples) - 1)]
    bi, tri, own = features(a, s, e)
    n, size = len(s), len(model.langs)
    # A byte's grams count for the word that they touch: from the blank before it to its last byte.
    lens = e - s + 1
    word = np.repeat(np.arange(n), lens)
    at = np.repeat(s - 1 - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
    bi, tri = bi[at], tri[at]
    starts = np.arange(0, n, SEQUENCE)
    lengths = np.diff(np.append(starts, n))
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    after = np.flatnonzero(inner)
    pairs = np.zeros((size, size))
    np.add.at(pairs, (gold[after - 1], gold[after]), 1)
    begun = np.bincount(gold[starts], minlength=size)
    target = np.zeros((n, size))
    target[np.arange(n), gold] = 1
    squares = [np.full(w.shape, 1e-2) for w in (model.bi, model.tri, model.own)]
    square_t, square_s = np.full((size, size), 1e-2), np.full(size, 1e-2)
    cuts = [*range(0, n, _PART), n]
    first_gram = np.concatenate([[0], np.cumsum(lens)])
    for _ in range(epochs):
        t, begin = np.exp(model.transitions), np.exp(model.start)
        slope_t, slope_s = np.zeros((size, size)), np.zeros(size)
        miss = np.empty((n, size), dtype=np.float32)
        for lo, hi in zip(cuts, cuts[1:]):
            g, h = first_gram[lo], first_gram[hi]
            score = np.zeros((hi - lo, size))
            for k in range(size):
                grams = np.bincount(word[g:h] - lo, weights=model.bi[bi[g:h], k] + model.tri[tri[g:h], k], minlength=hi - lo)
                score[:, k] = grams + model.own[own[lo:hi], k].sum(axis=1)
            psi = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -50))
            at = np.arange(lo, hi, SEQUENCE)
            alpha, beta, _ = forward_backward(psi, t, at - lo, np.diff(np.append(at, hi)), begin)
            p = alpha * beta
            p /= p.sum(axis=1, keepdims=True)
            slope_t += pair_expectations(alpha, psi * beta, t, after[(after >= lo) & (after < hi)] - lo)
            slope_s += p[at - lo].sum(axis=0)
            miss[lo:hi] = -p
        miss[np.arange(n), gold] += 1
        slope_t = (pairs - slope_t) / n - decay * model.transitions
        slope_s = (begun - slope_s) / n - decay * model.start
        square_t += slope_t**2
        square_s += slope_s**2
        model.transitions += rate * slope_t / np.sqrt(square_t)
        model.start += rate * slope_s / np.sqrt(square_s)
        for w, sq, rows in ((model.bi, squares[0], bi), (model.tri, squares[1], tri), (model.own, squares[2], None)):
            for k in range(size):
                if rows is None:
                    g = sum(np.bincount(own[:, c], weights=miss[:, k], minlength=len(w)) for c in range(own.shape[1])) / n
                else:
                    g = np.bincount(rows, weights=np.repeat(miss[:, k], lens), minlength=len(w)) / n
                g -= decay * w[:, k] * (g != 0)
                sq[:, k] += g**2 * 100
                w[:, k] += rate * g * 10 / np.sqrt(sq[:, k])
    return model


def pair_expectations(alpha: np.ndarray, later: np.ndarray, t: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Expected numbers of each transition into the positions `after`; later is psi * beta. No array has a row for each
    position and pair of languages."""
    a, b = alpha[after - 1], later[after]
    z = ((a @ t) * b).sum(axis=1, keepdims=True)
    return t * (a.T @ (b / z))


def stretches(text: bytes | None) -> list[bytes]:
    """The whole text in parts of STRETCH words."""
    words = (text or b"").split()
    return [b" ".join(words[k : k + STRETCH]) for k in range(0, len(words), STRETCH)]


def learn(docs: DataFrame, parts: int = 4, held_out: int = 2, most: int = DOCS) -> Model:
    """From the whole texts of at most `most` documents of each language, none of the held-out fold."""
    own = docs.where("lang is not null and doc_id is not null").where(fold(F.col("doc_id"), parts) != held_out)
    ids = own.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), F.xxhash64("text").alias("t"))
    # One row for each id and language, then the first ids of each language.
    one = Window.partitionBy("id", "l").orderBy("t")
    first = Window.partitionBy("l").orderBy(F.xxhash64("id"), "id")
    ids = ids.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    ids = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).drop("n")
    ids = Kept(ids, "taught").df
    same = (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l")) & (F.xxhash64("text") == F.col("t"))
    chosen = docs.select("doc_id", "text", "lang").join(ids, same).dropDuplicates(["id", "l"]).select("text", "lang").toArrow()
    found = sorted((lang, part) for lang, text in zip(chosen.column("lang").to_pylist(), raw(chosen.column("text"))) for part in stretches(text))
    return fit(found)


def identify(docs: DataFrame, model: Model, parts: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    told = sent(docs.sparkSession, "langid", model)

    def run(batches):
        for batch in slices(batches, most=4 << 20):
            langs, scores = told().predict(raw(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
            )

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "lang_pred", "score")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each word: doc_id, start and end (in characters), lang_pred, probability; none where identify says `und`."""
    told = sent(docs.sparkSession, "langid", model)

    def run(batches):
        model = told()
        for batch in slices(batches, most=1 << 20):
            texts = raw(batch.column(1))
            if not model.langs:
                continue
            p, start, end, first, number = model.marginals(texts)
            best = p.argmax(axis=1)
            for i in np.flatnonzero(number).tolist():
                if not model.speaks(texts[i]):
                    continue
                at = slice(first[i], first[i] + number[i])
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(texts[i], dtype=np.uint8) & 0xC0) != 0x80)])
                n = int(number[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array(chars[start[at]]), pa.array(chars[end[at]]),
                        pa.array([model.langs[k] for k in best[at].tolist()]), pa.array(p[at][np.arange(n), best[at]]),
                    ],
                    names=["doc_id", "start", "end", "lang_pred", "probability"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, lang_pred string, probability double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
