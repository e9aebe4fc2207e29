"""Operator 4: token counts by section, with documents encoded whole.

A document is encoded once, whole; byte-level tokens tile its bytes, so the running sum of their lengths
gives each token's span. Sections tile the text as well. Both lists are sorted, so the interval join is a
merge: each token's first and last byte find their sections by binary search. A token inside one section
counts there; one that crosses a boundary is allocated by a rule:
  "most"   the section that holds most of its bytes, the earlier one if equal (the default),
  "first"  the section of its first byte,
  "last"   the section of its last byte.
So the sections' counts add up to the document's tokens. Each row is handled on its own; nothing is shuffled.

Sections here are paragraphs: a line with the line feed that ends it. Spans are in characters.

Defined results: a null or empty text has one section, number 0, from 0 to 0, with no tokens; a null doc_id
stays null; equal rows give equal rows; an empty table gives an empty result; other columns are not read.
A text that the encoder cannot take whole (its matcher's limit) is the only one encoded in parts, cut
before a blank that follows a non-blank, where the pattern always parts. Where there is none, the longest run of
blanks is matched by hand: all of it at the text's end, else all but its last blank, are one piece.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import process_cache, slices, table

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("most", "first", "last")
COUNTS = "doc_id long, section int, start long, end long, tokens long"
_CUT = re.compile(r"(?<=\S)(?= )")
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")  # the encoder's blanks


class Encoder:
    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, k in ranks.items():
            self.lengths[k] = len(token)

    def ids(self, text: str) -> list[int]:
        try:
            return self.encoding.encode_ordinary(text)
        except BaseException as e:
            # The matcher's limit comes as a panic, which is no Exception; interrupts and a lack of memory are not its limit.
            if isinstance(e, MemoryError) or not (isinstance(e, Exception) or type(e).__name__ == "PanicException"):
                raise
            cuts = [m.start() for m in _CUT.finditer(text)]
            if not cuts:
                run = max(_RUN.finditer(text), key=lambda m: m.end() - m.start(), default=None)
                if run is None:
                    raise
                start, end = run.start(), run.end() - (run.end() < len(text))
                return self.ids(text[:start]) + self.encoding._encode_single_piece(text[start:end]) + self.ids(text[end:])
            at = min(cuts, key=lambda c: abs(c - len(text) // 2))
            return self.ids(text[:at]) + self.ids(text[at:])

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.lengths[np.array(self.ids(text), dtype=np.int64)])


def paragraphs(text: bytes) -> np.ndarray:
    """Where each section ends, in bytes."""
    ends = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> np.ndarray:
    """Tokens of each section; both lists are ends of spans that tile the text."""
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    if rule == "last":
        own = last
    else:
        own = first.copy()
        if rule == "most":
            for i in np.flatnonzero(first != last).tolist():
                inner = section_ends[first[i] : last[i]]
                held = np.diff(np.concatenate([[starts[i]], inner, [token_ends[i]]]))
                own[i] = first[i] + int(np.argmax(held))
    return np.bincount(own, minlength=len(section_ends))


def _count(path: str | None, sections, rule: str):
    def run(batches):
        held = process_cache()
        if ("encoder", path) not in held:
            held["encoder", path] = Encoder(path)
        encoder = held["encoder", path]
        for batch in slices(batches, most=4 << 20):
            docs, number, start, end, tokens = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    cuts, counts = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
                else:
                    data = text.encode()
                    ends = sections(data)
                    counts = attribute(encoder.ends(text), ends, rule)
                    if len(data) == len(text):
                        cuts = ends
                    else:
                        cuts = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)[ends - 1]
                docs.append(np.full(len(cuts), 0 if doc is None else doc))
                number.append(np.arange(len(cuts)) * (1 if doc is not None else -1) - (doc is None))
                start.append(np.concatenate([[0], cuts[:-1]]))
                end.append(cuts)
                tokens.append(counts)
            docs, number, start, end, tokens = map(np.concatenate, (docs, number, start, end, tokens))
            unknown = number < 0  # a null doc_id, marked so that numbers stay plain arrays
            number = np.where(unknown, -1 - number, number)
            cols = [pa.array(docs, pa.int64(), mask=unknown), pa.array(number, pa.int32())]
            cols += [pa.array(x, pa.int64()) for x in (start, end, tokens)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "section", "start", "end", "tokens"])

    return run


def token_counts(docs: DataFrame, rule: str = "most", sections=paragraphs, path: str | None = None) -> DataFrame:
    """One row per section: doc_id, section (from 0), start and end in characters, tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return docs.select("doc_id", "text").mapInArrow(_count(path, sections, rule), COUNTS)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
