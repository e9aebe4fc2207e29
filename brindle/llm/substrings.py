"""Operator 6: passages of WINDOW words that an earlier document has too, by a compressed FM-index for each shard.

1. Documents are packed into slices, files in the shared folder that all later steps read. Every window of 13
   words belongs to an anchor, the smallest hash of its 8-word grams; runs of windows with one anchor are a piece.
2. Only anchors go to shards first, 8 bytes a piece. Those that two pieces have anywhere come back to their
   slices; all others cannot be in a repeat, and their text never moves.
3. Pieces with such anchors go to the shard of their anchor: equal windows meet in one shard, wherever they
   stand. An anchor with more than HOT pieces is split: its windows go one by one to the shards of their own
   hashes. What is the same within a slice goes once, so a passage that a third of all rows hold leaves a slice
   once; the slice remembers where it stands. Pieces travel compressed, a bundle for each slice and shard.
4. A shard builds one FM-index over its pieces: a Burrows-Wheeler transform over word numbers in a wavelet matrix
   of packed bits with rank counts, packed bits for where suffixes begin to differ at each depth, and for each
   13-word interval of several suffixes the smallest doc_id among them. No suffix order, text or document list is
   kept. Each piece is then streamed through the index once, from its last word to its first, and keeps the
   longest match at every word (matching statistics, cut at 13): a step prolongs the match to the left, and where
   that fails or the match is full, its last word is given up. Where a match reaches 13 words, the interval's
   smallest doc_id tells from which document on the window is a repeat.
5. These runs of windows go back to their slices, whose documents are cut by them.

Suffixes are sorted by their first 16 words, which is deeper than any match is followed.

Defined results: a null text has no words; documents of fewer than 13 words lose none; a null doc_id is
larger than any other; rows with one doc_id are one document to the rule, so they take nothing from each
other, and each row is cut and reported; an empty table gives an empty result; other columns are not read.
A text of any length is one document: it is in one slice, whole, and its pieces have at most PIECE windows.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, raw, slices, table

WINDOW = 13
GRAM = 8
#: Windows in a piece at most; longer runs of one anchor are cut.
PIECE = 48
#: Pieces of one anchor beyond which its windows go to shards one by one.
HOT = 4096
#: Bytes of texts for each shard of pieces, for each shard of anchors, and for a slice.
SHARD_BYTES = 8 << 20
ANCHOR_BYTES = 128 << 20
SLICE_BYTES = 4 << 20
#: Tasks for shards at most; a task takes its shards one after the other.
TASKS = 1 << 16
#: Suffixes are told apart by so many words; a power of two above WINDOW.
DEPTH = 16
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE = "slice long, bytes long, blob binary"
_SHIP = "shard long, slice long, blob binary"
_REPLY = "slice long, blob binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of so many."""
    n, m, have = len(g) - width + 1, g, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[width - have : width - have + n])


class _Words:
    """Texts with single blanks: the bytes and ends of all words, hashes of any run of words in one step."""

    def __init__(self, norms: list[bytes]):
        self.whole = b"\n".join(norms) + b"\n"
        a = np.frombuffer(self.whole, dtype=np.uint8)
        up, self.down = _Powers.get(len(a) + 1)
        self.ends = np.flatnonzero((a == 32) | (a == 10))
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.h = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        self.text = np.concatenate([[0], np.cumsum(a[self.ends] == 10)[:-1]])
        self.first = np.searchsorted(self.text, np.arange(len(norms)))

    def hash(self, head: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        s, e = self.starts[head], self.ends[head + n - 1]
        return _mix((self.h[e] - self.h[s]) * self.down[s])

    def bytes(self, head: np.ndarray, n: np.ndarray) -> list[bytes]:
        return [self.whole[i:j] for i, j in zip(self.starts[head].tolist(), self.ends[head + n - 1].tolist())]


def _pieces(w: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first word (among all texts' words) and number of words of each piece."""
    none = np.zeros(0, dtype=np.int64)
    if len(w.ends) < WINDOW:
        return none.astype(np.uint64), none, none
    grams = w.hash(np.arange(len(w.ends) - GRAM + 1), GRAM)
    anchor = _least(grams, WINDOW - GRAM + 1)
    at = np.flatnonzero(w.text[: len(anchor)] == w.text[WINDOW - 1 :])
    if not len(at):
        return none.astype(np.uint64), none, none
    new = np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (w.text[at][1:] != w.text[at][:-1])])
    begun = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - begun) % PIECE == 0
    head = np.flatnonzero(new)
    return anchor[at[head]], at[head], np.diff(np.append(head, len(at))) + WINDOW - 1


def _windows(head: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First words of all windows of pieces."""
    many = n - WINDOW + 1
    return np.repeat(head - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())


def _rows(schema: str, *cols) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=list(names))


def _pack(most: int):
    """Input rows -> slices: ids, whether an id is null, lengths in bytes, words joined by single blanks."""

    def run(batches):
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=3)
        at = None
        for batch in slices(batches, most=most):
            at = TaskContext.get().partitionId() << 34 if at is None else at + 1
            ids = batch.column(0).to_pylist()
            norms = [b" ".join((x or b"").split()) for x in raw(batch.column(1))]
            head = np.array([_LAST if i is None else i for i in ids], dtype="<i8").tobytes() + np.array([i is None for i in ids], dtype="u1").tobytes()
            head += np.array([len(x) for x in norms], dtype="<i8").tobytes()
            yield _rows(_SLICE, [at], [sum(map(len, norms))], [struct.pack("<i", len(ids)) + squeeze.compress(head + b"".join(norms))])

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    n = struct.unpack_from("<i", blob)[0]
    data = zstandard.ZstdDecompressor().decompress(blob[4:])
    ids, nulls, lens = np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n), np.frombuffer(data, "<i8", n, 9 * n)
    ends = (17 * n + np.cumsum(lens)).tolist()
    return ids, nulls.astype(bool), [data[j - k : j] for j, k in zip(ends, lens.tolist())]


def _long_enough(norms: list[bytes]) -> list[int]:
    return [i for i, x in enumerate(norms) if x.count(b" ") >= WINDOW - 1]


def _by_shard(shard: np.ndarray):
    """(shard, places) for each shard that has places."""
    order = np.argsort(shard, kind="stable")
    held = shard[order]
    lows = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else []
    for lo, hi in zip(lows, [*lows[1:], len(held)]):
        yield int(held[lo]), order[lo:hi]


def _anchors(shards: int):
    """Slices -> for each slice and shard its anchors; first those of one piece of the slice, last the others' counts."""

    def run(batches):
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                norms = _unpack(blob)[2]
                anchor = _pieces(_Words([norms[i] for i in _long_enough(norms)]))[0]
                anchor, times = np.unique(anchor, return_counts=True)
                out = [[], []]
                for k, own in _by_shard((anchor % np.uint64(shards)).astype(np.int64)):
                    own = own[np.argsort(times[own] > 1, kind="stable")]
                    many = times[own][times[own] > 1]
                    out[0].append(k)
                    out[1].append(struct.pack("<ii", len(own), len(many)) + anchor[own].tobytes() + many.astype("<u4").tobytes())
                yield _rows(_SHIP, out[0], [at] * len(out[0]), out[1])

    return run


def _repeated(hot: int):
    """A shard's anchors -> for each slice those that more than one piece has, those of more than `hot` pieces last."""

    def run(batches):
        of, held, times = [], [], []
        for batch in batches:
            for at, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, many = struct.unpack_from("<ii", blob)
                of.append(np.full(n, at))
                held.append(np.frombuffer(blob, "<u8", n, 8))
                times.append(np.ones(n, dtype=np.uint32))
                times[-1][n - many :] = np.frombuffer(blob, "<u4", many, 8 + 8 * n)
        if not held:
            return
        of, held, times = map(np.concatenate, (of, held, times))
        _, back = np.unique(held, return_inverse=True)
        total = np.bincount(back, weights=times)[back]
        stay = np.flatnonzero(total > 1)
        for k in range(0, len(stay), 1 << 20):
            part = stay[k : k + (1 << 20)]
            part = part[np.argsort(total[part] > hot, kind="stable")]
            at, own, cold = of[part], held[part], total[part] <= hot
            groups = list(_by_shard(at))
            yield _rows(_REPLY, [g for g, _ in groups], [struct.pack("<i", int(cold[p].sum())) + own[p].tobytes() for _, p in groups])

    return run


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in known (sorted)."""
    return known[np.searchsorted(known, x).clip(max=len(known) - 1)] == x if len(known) else np.zeros(len(x), dtype=bool)


def _ship(shards: int):
    """Slices with their repeated anchors -> bundles of different pieces for shards, and where each stands (shard -1)."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at, blob, replies in zip(*(batch.column(i).to_pylist() for i in range(3))):
                cold = np.sort(np.frombuffer(b"".join(r[4 : 4 + 8 * struct.unpack_from("<i", r)[0]] for r in replies), dtype="<u8"))
                hot = np.sort(np.frombuffer(b"".join(r[4 + 8 * struct.unpack_from("<i", r)[0] :] for r in replies), dtype="<u8"))
                ids, _, norms = _unpack(blob)
                own = np.array(_long_enough(norms), dtype=np.int64)
                w = _Words([norms[i] for i in own.tolist()])
                anchor, head, n = _pieces(w)
                one_by_one = _windows(*(x[_among(anchor, hot)] for x in (head, n)))
                some = _among(anchor, cold)
                key = np.concatenate([anchor[some], w.hash(one_by_one, WINDOW)])
                head, n = np.concatenate([head[some], one_by_one]), np.concatenate([n[some], np.full(len(one_by_one), WINDOW)])
                texts = w.bytes(head, n)
                names: dict[bytes, int] = {}
                piece = np.fromiter((names.setdefault(t, len(names)) for t in texts), dtype=np.int64, count=len(texts))
                row = own[w.text[head]] if len(head) else head
                where = np.stack([piece, row, head - w.first[w.text[head]] if len(head) else head], axis=1).astype("<i4")
                least, most = np.full(len(names), _LAST), np.full(len(names), -_LAST - 1)
                np.minimum.at(least, piece, ids[row])
                np.maximum.at(most, piece, ids[row])
                shard = np.zeros(len(names), dtype=np.int64)
                shard[piece] = (key % np.uint64(shards)).astype(np.int64)
                lens = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
                texts = list(names)
                out = [[-1], [squeeze.compress(where.tobytes())]]
                for k, p in _by_shard(shard):
                    body = b"".join(x.astype(t).tobytes() for x, t in ((p, "<i4"), (lens[p], "<i4"), (least[p], "<i8"), (most[p], "<i8")))
                    out[0].append(k)
                    out[1].append(struct.pack("<i", len(p)) + squeeze.compress(body + b"".join([texts[i] for i in p.tolist()])))
                yield _rows(_SHIP, out[0], [at] * len(out[0]), out[1])

    return run


class Bits:
    """Packed bits with rank (ones before a position) and select (the position of the k-th one, from 1)."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def select(self, k: np.ndarray) -> np.ndarray:
        k = k.astype(np.int32)
        w = np.searchsorted(self.before, k, side="left") - 1
        left, word, at = (k - self.before[w]).astype(np.int64), self.words[w], np.zeros(len(k), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = word & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            up = n < left
            left, at = left - n * up, at + width * up
            word = np.where(up, word >> np.uint64(width), low)
        return w * 64 + at


class FMIndex:
    """Over numbers from 0, where 0 parts the texts and ends the last: a wavelet matrix of the Burrows-Wheeler
    transform, and for each depth up to `most` the rows at which the suffixes' first words change."""

    def __init__(self, text: np.ndarray, most: int = WINDOW):
        n = self.n = len(text)
        self.most = most
        order = self._order(text)
        last = text[order - 1]
        self.sigma = sigma = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels, self.zeros = [], []
        self.depth = max(1, (sigma - 1).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bits = (last >> level & 1).astype(np.uint8)
            self.levels.append(Bits(bits))
            self.zeros.append(int(n - bits.sum()))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        self.starts = self._trace(np.arange(sigma), np.zeros(sigma, dtype=np.int64))
        self.changes = [None]
        same, longer = np.ones(max(0, n - 1), dtype=bool), np.append(text, np.zeros(most, dtype=text.dtype))
        for d in range(most):
            same &= longer[order[1:] + d] == longer[order[:-1] + d]
            self.changes.append(Bits(np.append(True, ~same)[:n]))
        self.order_hook(order)

    @staticmethod
    def _order(text: np.ndarray) -> np.ndarray:
        n, have = len(text), 1
        rank = text.astype(np.int64)
        while have < DEPTH:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - have)] = rank[have:] + 1
            _, rank = np.unique(rank * (after.max(initial=0) + 1) + after, return_inverse=True)
            have *= 2
        return np.argsort(rank, kind="stable")

    def order_hook(self, order: np.ndarray) -> None:
        """Called once with the suffix order, which is not kept."""

    def _trace(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Position i of the transform, followed through the levels of c."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (c >> (self.depth - 1 - k) & 1).astype(bool)
            b = bits.rank(i)
            i = np.where(one, zeros + b, i - b)
        return i

    def left(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step of backward search: rows that have c before what rows low to high begin with; c from 1 to sigma - 1."""
        i = self._trace(np.concatenate([c, c]), np.concatenate([low, high]))
        base = self.first[c] - self.starts[c]
        return i[: len(c)] + base, i[len(c) :] + base

    def parent(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first `depth` words of what each interval stands for."""
        wide_low, wide_high = np.zeros(len(low), dtype=np.int64), np.full(len(low), self.n)
        for d in np.unique(depth).tolist():
            if d:
                at, bits = np.flatnonzero(depth == d), self.changes[d]
                wide_low[at] = bits.select(bits.rank(low[at] + 1).astype(np.int64))
                after = bits.rank(high[at]).astype(np.int64) + 1
                inner = after <= int(bits.before[-1]) + int(np.bitwise_count(bits.words[-1]))
                wide_high[at[inner]] = bits.select(after[inner])
        return wide_low, wide_high

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """For each word of each stretch of text: how many words from it on (`most` at most, within the stretch) are
        in the index, and the interval of rows of that match. Stretches go side by side, from last to first words."""
        size = int(lengths.sum())
        base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        found, lows, highs = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends, outs, n = (starts + lengths)[order], (base + lengths)[order], lengths[order]
        low, high, have = np.zeros(len(n), dtype=np.int64), np.full(len(n), self.n), np.zeros(len(n), dtype=np.int64)
        for t in range(1, int(n[0]) + 1 if len(n) else 1):
            on = int(np.searchsorted(-n, -t, side="right"))
            c = text[ends[:on] - t]
            full = np.flatnonzero(have[:on] == self.most)
            if len(full):
                have[full] -= 1
                low[full], high[full] = self.parent(low[full], high[full], have[full])
            todo = np.flatnonzero((c > 0) & (c < self.sigma))
            lost = np.flatnonzero((c <= 0) | (c >= self.sigma))
            low[lost], high[lost], have[lost] = 0, self.n, 0
            while len(todo):
                a, b = self.left(c[todo], low[todo], high[todo])
                yes = b > a
                on_ = todo[yes]
                low[on_], high[on_], have[on_] = a[yes], b[yes], have[on_] + 1
                todo = todo[~yes]
                none = todo[have[todo] == 0]
                low[none], high[none] = 0, self.n
                todo = todo[have[todo] > 0]
                if len(todo):
                    have[todo] -= 1
                    low[todo], high[todo] = self.parent(low[todo], high[todo], have[todo])
            at = outs[:on] - t
            found[at], lows[at], highs[at] = have[:on], low[:on], high[:on]
        return found, lows, highs


class Shard(FMIndex):
    """An index over pieces, each with the smallest doc that has it."""

    def __init__(self, pieces: list[bytes], docs: np.ndarray, window: int = WINDOW):
        words = [p.split(b" ") for p in pieces]
        self.lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        names: dict[bytes, int] = {}
        text = np.zeros(int(self.lens.sum()) + len(words), dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lens + 1)])[:-1]
        inside = np.ones(len(text), dtype=bool)
        inside[self.at + self.lens] = False
        text[inside] = np.fromiter((names.setdefault(w, len(names) + 1) for x in words for w in x), dtype=np.int64, count=int(self.lens.sum()))
        self.docs = docs
        super().__init__(text, window)
        self.text = text  # what is streamed through the index; the index itself does not use it

    def order_hook(self, order: np.ndarray) -> None:
        bits = self.changes[self.most]
        begin = bits.select(np.arange(1, int(bits.rank(np.array([self.n]))[0]) + 1)) if self.n else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(begin, self.n))
        self.several = Bits(size > 1)
        owner = np.repeat(self.docs, self.lens + 1)[order]
        self.least = np.minimum.reduceat(owner, begin)[size > 1] if self.n else owner

    def earliest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each piece is streamed through the index -> piece, window and smallest doc of all full matches, in order."""
        found, low, _ = self.matching_statistics(self.text, self.at, self.lens)
        piece = np.repeat(np.arange(len(self.lens)), self.lens)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        at = np.flatnonzero(found == self.most)
        of = self.changes[self.most].rank(low[at] + 1).astype(np.int64) - 1
        doc = self.docs[piece[at]].copy()
        many = (self.several.rank(of + 1) - self.several.rank(of)).astype(bool)
        doc[many] = self.least[self.several.rank(of[many])]
        return piece[at], offset[at], doc


def _search(batches):
    """Bundles in order of shard -> for each slice runs of windows: its piece's number, first window, how many, smallest doc."""
    grow = zstandard.ZstdDecompressor()
    held: list[tuple[int, bytes]] = []
    now = None

    def flush():
        names: dict[bytes, int] = {}
        cols = [[] for _ in range(5)]
        for at, blob in held:
            n = struct.unpack_from("<i", blob)[0]
            data = grow.decompress(blob[4:])
            number, lens = np.frombuffer(data, "<i4", n), np.frombuffer(data, "<i4", n, 4 * n)
            ends = (24 * n + np.cumsum(lens, dtype=np.int64)).tolist()
            own = [names.setdefault(data[j - k : j], len(names)) for j, k in zip(ends, lens.tolist())]
            for c, x in zip(cols, (np.full(n, at), number, np.array(own, dtype=np.int64), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, "<i8", n, 16 * n))):
                c.append(x)
        held.clear()
        at, number, own, least, most = map(np.concatenate, cols)
        docs = np.full(len(names), _LAST)
        np.minimum.at(docs, own, least)
        pieces = list(names)
        names.clear()
        piece, first, n, doc = _runs(*Shard(pieces, docs).earliest())
        # Runs of a piece go to all slices that have it, if a document there is later than the smallest.
        low, high = np.searchsorted(piece, own), np.searchsorted(piece, own, side="right")
        source = np.repeat(np.arange(len(own)), high - low)
        run = np.arange(len(source)) - np.repeat(np.cumsum(high - low) - high, high - low)
        say = doc[run] < most[source]
        source, run = source[say], run[say]
        for k, p in _by_shard(at[source]):
            counts = np.stack([number[source[p]], first[run[p]], n[run[p]]], axis=1).astype("<i4")
            yield k, struct.pack("<i", len(p)) + counts.tobytes() + doc[run[p]].astype("<i8").tobytes()

    for batch in batches:
        out = []
        for shard, at, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if shard != now and held:
                out += flush()
            now = shard
            held.append((at, blob))
        if out:
            yield _rows(_REPLY, *zip(*out))
    if held and (out := list(flush())):
        yield _rows(_REPLY, *zip(*out))


def _runs(piece: np.ndarray, offset: np.ndarray, doc: np.ndarray):
    """Windows in order -> runs of neighbouring ones with one doc: piece, first window, number of windows, doc."""
    if not len(piece):
        return piece, offset, offset, doc
    at = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1) | (doc[1:] != doc[:-1])]))
    return piece[at], offset[at], np.diff(np.append(at, len(piece))), doc[at]


def _told(places: bytes | None, replies: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first words and lengths of the intervals that go."""
    none = np.zeros(0, dtype=np.int64)
    if not places or not replies:
        return none, none, none
    where = np.frombuffer(zstandard.ZstdDecompressor().decompress(places), "<i4").reshape(-1, 3).astype(np.int64)
    sizes = [struct.unpack_from("<i", r)[0] for r in replies]
    runs = np.concatenate([np.frombuffer(r, "<i4", 3 * k, 4).reshape(-1, 3) for r, k in zip(replies, sizes)]).astype(np.int64)
    doc = np.concatenate([np.frombuffer(r, "<i8", k, 4 + 12 * k) for r, k in zip(replies, sizes)])
    order = np.argsort(runs[:, 0], kind="stable")
    runs, doc = runs[order], doc[order]
    low, high = np.searchsorted(runs[:, 0], where[:, 0]), np.searchsorted(runs[:, 0], where[:, 0], side="right")
    place = np.repeat(np.arange(len(where)), high - low)
    run = np.arange(len(place)) - np.repeat(np.cumsum(high - low) - high, high - low)
    go = doc[run] < ids[where[place, 1]]
    place, run = place[go], run[go]
    return where[place, 1], where[place, 2] + runs[run, 1], runs[run, 2] + WINDOW - 1


def _cut(batches):
    """Slices with their pieces' places and runs -> what is left of each document."""
    for batch in batches:
        for blob, places, replies in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            ids, nulls, norms = _unpack(blob)
            row, start, length = _told(places, replies or [], ids)
            order = np.argsort(row, kind="stable")
            row, start, length = row[order], start[order], length[order]
            bounds = np.searchsorted(row, np.arange(len(norms) + 1)).tolist()
            n_words, n_removed, left = [], [], []
            for i, norm in enumerate(norms):
                lo, hi = bounds[i], bounds[i + 1]
                n = norm.count(b" ") + 1 if norm else 0
                kept = n
                if lo < hi:
                    change = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(change, start[lo:hi], 1)
                    np.add.at(change, start[lo:hi] + length[lo:hi], -1)
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    words = norm.split(b" ")
                    norm, kept = b" ".join([words[k] for k in stay]), len(stay)
                n_words.append(n)
                n_removed.append(n - kept)
                left.append(norm)
            cols = [pa.array(ids, pa.int64(), mask=nulls), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept"])


def _digest(batches):
    for batch in _cut(batches):
        shas = [hashlib.sha256(x).hexdigest() for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shas)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def cut_slices(docs: DataFrame, slice_bytes: int = SLICE_BYTES, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """slice, blob (the packed documents), places (where its pieces stand) and blobs (their runs), null if there are none."""
    packed = Kept(docs.select("doc_id", "text").mapInArrow(_pack(slice_bytes), _SLICE), "slices").df
    size = packed.agg(F.sum("bytes")).first()[0] or 0
    packed = packed.select("slice", "blob")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few, many = (max(least, -(-size // x)) for x in (ANCHOR_BYTES, shard_bytes))
    replies = packed.mapInArrow(_anchors(few), _SHIP).repartition(min(few, TASKS), "shard").mapInArrow(_repeated(hot), _REPLY)
    # A slice's replies are bounded by the slice.
    told = packed.join(replies.groupBy("slice").agg(F.collect_list("blob").alias("blobs")), "slice")
    shipped = Kept(told.mapInArrow(_ship(many), _SHIP), "pieces").df
    found = shipped.where("shard >= 0").repartition(min(many, TASKS), "shard").sortWithinPartitions("shard").mapInArrow(_search, _REPLY)
    found = found.groupBy("slice").agg(F.collect_list("blob").alias("blobs"))
    found = shipped.where("shard < 0").select("slice", F.col("blob").alias("places")).join(found, "slice")
    return packed.join(found, "slice", "left").select("slice", "blob", "places", "blobs")


def without_repeats(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words themselves, joined by single blanks."""
    out = cut_slices(docs, slice_bytes).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.decode("kept", "UTF-8"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_slices(table(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select doc_id, i, array_to_string(words[i:i + 12], ' ') as win
  from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w)),
f as (select win, min(doc_id) as first_doc from s group by win having min(doc_id) < max(doc_id)),
g as (
  select distinct s.doc_id, s.i + o.range as i
  from s join f on s.win = f.win and f.first_doc < s.doc_id, range(13) o),
p as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
k as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by i) as kept
  from p where not exists (select 1 from g where g.doc_id = p.doc_id and g.i = p.i) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""
