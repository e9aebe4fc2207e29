"""Operator 9: best-fit-decreasing packing of token sequences.

A document's tokens are its ids and a closing id; a longer one than a sequence is cut into full pieces and
a last one. Pieces carry only their length and checksum, so what is shuffled is small. Pieces are dealt by
their place (task and running number, whatever they hold) into groups of about GROUP pieces, as many groups as
the data need, so equal rows spread like any others. Each group is packed by best-fit decreasing: a segment tree
over the remaining capacities 0..L finds the tightest open sequence in log L steps. A group can waste about one
sequence of the thousands that it fills; one group is what is packed as a whole.

Tokenizing goes through a table of white-space-delimited chunks: the tokenizer splits at white space and
looks at nothing across it, so a chunk's ids are the same in every text. Chunks whose characters are all
below U+0100 are split here and only their pieces go to the tokenizer's model; all others go to the
tokenizer whole. Tests compare with encoding whole texts.

Defined results: a null or empty text is one piece, the closing id; a null doc_id packs like any other;
equal rows are packed each; pieces of equal length go in order of doc_id, piece and checksum; a text of any length
is encoded whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, process_cache, slices, table

LENGTH = 2048
CLOSE = 0
VOCABULARY = "word_bpe_49k.json"
#: Pieces packed together, about.
GROUP = 40_000
#: Chunks of which a task begins its memory anew, keeping those before for once: some 60 MB; pieces of words: 80 MB.
REMEMBER, PIECES_KEPT = 150_000, 400_000
#: Signs that no piece has together with letters; an apostrophe may begin one.
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def _words(text: str) -> list[str]:
    """Parted at white space; str.split() also parts at four separators that the tokenizer does not."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in _SPACE.split(text) if w]
    return text.split()



def _byte_characters() -> dict[int, str]:
    """Bytes as the printable characters that byte-level vocabularies write them with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}


class Chunks(dict):
    """chunk -> its number; ids of all chunks lie one behind the other."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = _byte_characters()
        self.pieces: dict[str, bytes] = {}  # ids as the bytes of an array: a third of a list's memory
        self.forget()

    def forget(self) -> None:
        """What was met since the last time is kept once more; so frequent chunks stay and rare ones go."""
        self.old, self.old_ids, self.old_ends = dict(self), getattr(self, "ids", None), getattr(self, "ends", None)
        self.clear()
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        self.ids = array("I")
        self.ends = array("q", [0])

    def __missing__(self, chunk: str) -> int:
        k = self.old.get(chunk)
        if k is not None:
            self.ids.extend(self.old_ids[self.old_ends[k] : self.old_ends[k + 1]])
        else:
            self.learn(chunk)
        self.ends.append(len(self.ids))
        n = self[chunk] = len(self.ends) - 2
        return n

    def learn(self, chunk: str) -> None:
        if chunk.isalpha() and len(chunk) <= 1000 and (chunk.isascii() or max(chunk) < "Ā"):
            piece = chunk.lower()  # a run of letters is one piece
            ids = self.pieces.get(piece)
            self.ids.frombytes(self.word(piece) if ids is None else ids)
        else:
            self.encode(chunk)

    def word(self, piece: str) -> bytes:
        plain = piece if piece.isascii() and piece.isalnum() else "".join(map(self.bytes.__getitem__, piece.encode()))
        ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        return ids

    def encode(self, chunk: str) -> None:
        latin = chunk.isascii() or max(chunk) < "Ā"
        if not latin or len(chunk) > 1000 or ("<|" in chunk and any(s in chunk for s in self.special)):
            self.ids.extend(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
            return
        head = chunk.rstrip(_SIGNS)
        # A word and then signs are two pieces; the pattern says so at a greater length.
        for piece in (head.lower(), chunk[len(head) :]) if head.isalpha() and len(head) < len(chunk) else self.split(chunk.lower()):
            ids = self.pieces.get(piece)
            self.ids.frombytes(self.word(piece) if ids is None else ids)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one behind the other, and where each text ends."""
        if len(self) > REMEMBER:
            self.forget()
        counts, numbers = np.zeros(len(texts), dtype=np.int64), []
        for i, t in enumerate(texts):
            words = _words(t) if t else ()
            counts[i] = len(words)
            numbers.append(np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)))
        number = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        flat, ends = np.array(self.ids, dtype=np.uint32), np.array(self.ends, dtype=np.int64)
        starts, lens = ends[:-1][number], np.diff(ends)[number]
        total = np.concatenate([[0], np.cumsum(lens)])
        at = np.repeat(starts - total[:-1], lens) + np.arange(total[-1])
        return flat[at], total[np.cumsum(counts)]


def _opened(path: str) -> Chunks:
    held = process_cache()
    if ("chunks", path) not in held:
        held["chunks", path] = Chunks(path)
    return held["chunks", path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Where a piece stands: its task in the upper bits, a running number in the lower.
PLACED = PIECES + ", place long"


def _pieces(name: str, length: int, close: int):
    def run(batches):
        from pyspark import TaskContext

        chunks = _opened(vocabulary_path(name))
        last = np.array([close], dtype="<u4")
        place = TaskContext.get().partitionId() << 40
        for batch in slices(batches, most=4 << 20):
            docs = batch.column(0).to_pylist()
            ids, ends = chunks.encode_all(batch.column(1).to_pylist())
            rows = []
            start = 0
            for doc, end in zip(docs, ends.tolist()):
                own = np.concatenate([ids[start:end].astype("<u4"), last])
                start = end
                for k, s in enumerate(range(0, len(own), length)):
                    part = own[s : s + length]
                    rows.append((doc, k, s, len(part), zlib.crc32(part.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            cols.append(pa.array(np.arange(place, place + len(rows))))
            place += len(rows)
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    return run


class Tightest:
    """A segment tree over remaining capacities: which capacity of at least n is the least that is open?"""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = self.size + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def find(self, least: int) -> int:
        """-1 if there is none."""
        i = self.size + least
        count = self.count
        if count[i]:
            return least
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each piece its sequence's number (from 0) and its offset there."""
    tree, open_at = Tightest(length), [[] for _ in range(length + 1)]
    number, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        capacity = tree.find(n)
        if capacity < 0:
            bin_, capacity = used, length
            used += 1
        else:
            bin_ = open_at[capacity].pop()
            tree.add(capacity, -1)
        number[i], offset[i] = bin_, length - capacity
        if capacity > n:
            open_at[capacity - n].append(bin_)
            tree.add(capacity - n, 1)
    return number, offset


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, close: int = CLOSE, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = Kept(docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, length, close), PLACED), "pieces").df
    groups = -(-pieces.count() // group)

    def run(key, held):
        held = held.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length", "ids_crc32")])
        number, offset = best_fit(held.column("length").to_numpy(), length)
        cols = [held.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        cols += [pa.array(number + (key[0].as_py() << 32)), pa.array(offset)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        return pa.table(cols, names=names)

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("place"), F.lit(max(1, groups)))).drop("place")
    return dealt.groupBy("_group").applyInArrow(run, PIECES + ", sequence_id long, offset long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
