"""Removal of passages that an earlier document has, by compressed FM-indexes.

Documents are cut into content-defined shards (see `repeats`). A shard's segments are
indexed: the Burrows-Wheeler transform of their words stands in a wavelet tree of
packed bits. The windows of all segments are then searched backwards, side by side, a
word a step; a window whose interval has shrunk to itself needs no further step. What
is left after all steps are matches of full length; the smallest document in such an
interval says whether the window stands in an earlier document.

Every word covered by a window that also starts in a document with a smaller doc_id
is removed; windows are judged on the input. Words are compared by 40 bits of their
hashes, all of a window's words at once.

Edge cases: a null or blank text has no words; texts shorter than a window lose
nothing; rows with one doc_id do not remove from each other; documents without an id
neither lose words nor take any; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, spread, sums_by_row
from .repeats import Marks, Shard, Unit, covered, marked_runs, marks, with_marks
from .suffixes import joined, suffix_array, windows


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit, on packed bits."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            one = (seq >> shift) & 1 == 1
            packed = np.packbits(np.r_[one, np.zeros(-len(one) % 64 + 64, bool)], bitorder="little").view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)]
            self.levels.append((packed, before, len(seq) - int(one.sum()), shift))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each query, the place that `at` has among the symbol's own, counted over the whole last level."""
        for packed, before, zeros, shift in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at


class FmIndex:
    """Backward search over texts of symbols 1..sigma, each closed by 0.

    Of the suffix array only which text each suffix belongs to is kept, beside the tree.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, close: np.ndarray) -> None:
        order = suffix_array(text, owner, close)
        self.owner = owner[order].astype(np.int32)
        before = text[order - 1]
        before[order == 0] = 0
        bits = max(1, int(text.max(initial=0)).bit_length())
        self.tree = WaveletTree(before, bits)
        sigma = np.arange(1 << bits)
        self.start = np.searchsorted(text[order], sigma)
        self.zero = self.tree.rank(sigma, np.zeros(1 << bits, np.int64))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that start with symbol and go on as those in the intervals given."""
        base = self.start[symbol] - self.zero[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)


def earliest(symbols: np.ndarray, offsets: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the texts the smallest doc that has it, and where each text's windows begin.

    doc: the smallest document in which each text stands.
    """
    _, small = np.unique(symbols, return_inverse=True)
    text, owner, close = joined(small, offsets)
    places, first = windows(offsets, length)
    out = doc[owner[places]] if len(places) else np.zeros(0, np.int64)
    if not len(places):
        return out, first
    index = FmIndex(text, owner, close)
    live = np.arange(len(places))
    last = text[places + length - 1]
    low, high = index.start[last], np.r_[index.start[1:], len(text)][last]
    for k in range(length - 2, -1, -1):
        # one match left is the window itself
        more = high - low > 1
        live, low, high = live[more], low[more], high[more]
        if not len(live):
            return out, first
        low, high = index.step(text[places[live] + k], low, high)
    more = high - low > 1
    live, low, high = live[more], low[more], high[more]
    if len(live):
        # equal windows have one interval, and intervals of different windows are apart
        own, back = np.unique(low, return_inverse=True)
        top = np.zeros(len(own), np.int64)
        top[back] = high
        held = doc[index.owner]
        cuts = np.stack([own, top], 1).ravel()
        least = np.minimum.reduceat(np.r_[held, np.iinfo(np.int64).max], cuts)[::2]
        out[live] = least[back]
    return out, first


def _engine(length: int):
    def engine(shard: Shard) -> Marks:
        least, first = earliest(shard.symbols, shard.offsets, shard.least, length)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        # windows that some place of the segment has from an earlier document, in runs with one earliest document
        flags = least < shard.most[owner]
        group = np.cumsum(np.r_[False, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])]) if len(owner) else owner
        a, b = marked_runs(flags, group)
        segment = owner[a]
        return Marks(segment, a - first[segment], b - first[segment], least[a])

    return engine


def dedup(docs: DataFrame, length: int = 13, k: int = 5, content: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with content the kept words as `kept`, of every row."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("x"), F.xxhash64("text", F.lit(1)).alias("y"), text.alias("text"))
    found = marks(own.where("x is not null"), Unit(length, k, words=True, width=5), _engine(length))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                part = batch.slice(block.first, len(block))
                starts, ends, _, first = block.words()
                gone = covered(part.column(2), part.column(3), first)
                removed = sums_by_row(gone, first)
                sizes = (ends - starts + 1)[~gone]
                # each kept word with the byte after it, which becomes the blank
                data = np.r_[block.data, np.uint8(0)][spread(starts[~gone], sizes)]
                stop = np.cumsum(sizes)
                data[stop - 1] = 0x20
                count = np.diff(first) - removed
                to = np.r_[0, stop][np.r_[0, np.cumsum(count)]]
                raw = data.tobytes()
                kept = [raw[a : max(a, b - 1)] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
                cols = [part.column(0), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                if content:
                    cols.append(pa.array([x.decode() for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * content])

    return with_marks(own, found).select(F.col("x").alias("doc_id"), "text", "begins", "ends").mapInArrow(run, schema)
