"""Removal of long repeated byte strings, by suffix arrays.

Documents are cut into content-defined shards (see `repeats`). A shard's segments are
sorted into suffix arrays of bounded size by Larsson-Sadakane refinement; Kasai's
common prefixes tell which windows are equal to another one's. If a shard needs
several arrays, the windows of each are looked up in the others by binary search.

Every byte covered by a window that also starts anywhere else, in the same document
or another, is removed, all copies included; windows are judged on the input.

Edge cases: a null text is empty; texts shorter than a window lose nothing; rows that
are alike in id and text are copies of each other like any others; documents without
an id take part; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, sums_by_row
from .repeats import Marks, Shard, Unit, covered, marked_runs, marks, with_marks
from .suffixes import common_prefixes, joined, suffix_array, windows

#: Symbols of one suffix array.
ARRAY_SYMBOLS = 3 << 20


def _less_than(texts: tuple[np.ndarray, np.ndarray], places: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of windows, whether the first is smaller, and whether they are equal."""
    n = len(places[0])
    less, same = np.zeros(n, bool), np.ones(n, bool)
    live, step = np.arange(n), 0
    while len(live) and step < length:
        a, b = texts[0][places[0][live] + step], texts[1][places[1][live] + step]
        less[live[a < b]] = True
        same[live[a != b]] = False
        live, step = live[a == b], step + 1
    return less, same


def found_in(text: np.ndarray, places: np.ndarray, other: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """The window of other, by order of its windows, that equals each window of text; -1 where none does."""
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(order))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        less, _ = _less_than((other, text), (order[middle], places[open_]), length)
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
    inside = low < len(order)
    out = np.full(len(places), -1)
    _, same = _less_than((text, other), (places[inside], order[low[inside]]), length)
    out[np.flatnonzero(inside)[same]] = low[inside][same]
    return out


def repeated_windows(symbols: np.ndarray, offsets: np.ndarray, copies: np.ndarray, length: int, most: int = ARRAY_SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the texts are found more than once, and where each text's begin among them.

    copies: how often each text stands in the corpus.
    """
    cuts = [0]
    while cuts[-1] < len(offsets) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + most, "right")) - 1))
    arrays = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = offsets[a : b + 1] - offsets[a]
        text, owner, close = joined(symbols[offsets[a] : offsets[b]], part)
        order = suffix_array(text, owner, close)
        label = np.cumsum(common_prefixes(text, owner, close, order) < length)
        places, first = windows(part, length)
        whole = np.zeros(len(text), bool)
        whole[places] = True
        take = whole[order]
        order, label = order[take], label[take]
        total = np.bincount(label, copies[a + owner[order]], int(label.max(initial=0)) + 1)
        count = np.zeros(len(text), np.int64)
        count[order] = total[label]
        arrays.append((text, places, first, order, count))
    flags = [count[places] > 1 for _, places, _, _, count in arrays]
    for i, (text, places, _, _, _) in enumerate(arrays):
        for j, (other, _, _, order, _) in enumerate(arrays):
            if i != j:
                todo = np.flatnonzero(~flags[i])
                flags[i][todo] |= found_in(text, places[todo], other, order, length) >= 0
    starts = [np.zeros(1, np.int64)]
    for _, _, first, _, _ in arrays:
        starts.append(first[1:] + starts[-1][-1])
    return (np.concatenate(flags) if flags else np.zeros(0, bool)), np.concatenate(starts)


def _engine(length: int):
    def engine(shard: Shard) -> Marks:
        flags, first = repeated_windows(shard.symbols, shard.offsets, shard.copies, length)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a, b = marked_runs(flags, owner)
        segment = owner[a]
        return Marks(segment, a - first[segment], b - first[segment], None)

    return engine


def named(docs: DataFrame) -> DataFrame:
    """x and y, two hashes that name a row by its id and text, and doc_id and text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return own.select(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64("text", F.lit(1), "doc_id").alias("y"), "doc_id", "text")


def spans(docs: DataFrame, length: int = 400, k: int = 64) -> DataFrame:
    """x, y, doc_id, text, and arrays `begins` and `ends` of the bytes that repeated strings cover."""
    own = named(docs)
    return with_marks(own, marks(own, Unit(length, k, words=False, width=1, shard_bytes=2 << 20), _engine(length)))


def dedup(docs: DataFrame, length: int = 400, k: int = 64, content: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with content the kept bytes (`kept`) of every row."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                part = batch.slice(block.first, len(block))
                gone = covered(part.column(2), part.column(3), block.offsets)
                removed = sums_by_row(gone, block.offsets)
                row = np.repeat(np.arange(len(block)), np.diff(block.offsets))
                opens, _ = marked_runs(gone, row)
                keep = block.data[~gone].tobytes()
                to = np.r_[0, np.cumsum(np.diff(block.offsets) - removed)].tolist()
                kept = [keep[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
                cols = [part.column(0), pa.array(np.diff(block.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(np.bincount(row[opens], minlength=len(block)), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                if content:
                    cols.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * content])

    return spans(docs, length, k).select("doc_id", "text", "begins", "ends").mapInArrow(run, schema)
