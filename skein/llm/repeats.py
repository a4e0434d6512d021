"""Finding repeated windows of fixed length over all documents, with content-defined shards.

A window is L symbols (bytes or words) of one document. Its minimiser is the run of k
symbols inside it whose hash is smallest, so equal windows have equal minimisers, and
neighbouring windows mostly share one. First the minimisers are counted: a window whose
minimiser is found once in the corpus is not repeated. Which ones are found again is
kept in a bitmap of fixed size (other minimisers may share a bit; that costs work, not
correctness). Then each run of windows with one repeated minimiser becomes a segment
and goes to the shard of its minimiser, where all equal windows meet. Equal segments
of a task travel once, with how often and from which to which row they stand. A
shard's engine tells which windows are repeated. The places of a segment never meet in
one task: they are joined to what the engine marks in the segment, and a segment that
stands in very many places is a skewed key of that join, which adaptive execution splits.
Segments are named by 64 bits, and equal names taken for equal segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Block, _bytes_pow, _words_pow, blocks, byte_codes, mix, span_hashes, spread, window_hashes, within
from .tables import partitions_for, text_size

_U = np.uint64
#: Bits of the bitmap of repeated minimisers: 16 MB, whatever the corpus.
BITS = 27
#: Bytes of text whose minimisers, or whose segments, one reducing task gathers.
_PER_TASK = 6 << 20


class Unit(NamedTuple):
    """What windows are made of."""

    length: int
    k: int
    words: bool
    #: bytes of a symbol in a segment
    width: int
    #: bytes of text for each shard, which bounds what one task indexes at once
    shard_bytes: int = 6 << 20

    def symbols(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """A hash code for each symbol, and where each row's symbols begin."""
        if self.words:
            _, _, codes, first = block.words()
            return codes, first
        return byte_codes(block.data), block.offsets

    def payload(self, block: Block, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The symbols at the places: bytes themselves, words by 40 bits of their hashes."""
        if self.words:
            return (codes[at] >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].ravel()
        return block.data[at]


def runs(codes: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: the first symbol, the symbol after the last window, and the minimiser's hash."""
    starts = within(offsets, unit.length)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    powers = _words_pow if unit.words else _bytes_pow
    grams = window_hashes(codes, unit.k, powers)
    best = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
    span, reach = unit.length - unit.k + 1, 1
    while 2 * reach <= span:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if span > reach:
        best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
    chosen = (best[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    fresh = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[fresh[1:], len(starts)] - 1
    return starts[fresh], starts[last] + unit.length, mix(grams[chosen[fresh]] + _U(11))


def repeated_minimisers(docs: DataFrame, unit: Unit, size: int) -> np.ndarray:
    """The bitmap, as bytes, of the minimisers that are found more than once."""
    power = max(3, min(BITS - 6, (partitions_for(docs.sparkSession, size, _PER_TASK) - 1).bit_length()))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            # found again within the task: entered twice, so that it counts as repeated
            keys = np.repeat(keys, np.minimum(counts, 2))
            bucket = (keys >> _U(64 - power)).astype(np.int64)
            rest = ((keys << _U(power)) >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            used, begin = np.unique(bucket, return_index=True)
            ends = [*begin[1:].tolist(), len(keys)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rest[a:b].tobytes() for a, b in zip(begin.tolist(), ends, strict=True)], pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                codes, offsets = unit.symbols(block)
                held.append(runs(codes, offsets, unit)[2])
                n += len(held[-1])
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def twice(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("entries").to_pylist()), np.uint8).reshape(-1, 5)
        keys = np.zeros((len(raw), 8), np.uint8)
        keys[:, :5] = raw
        keys = np.sort(keys.view("<u8").ravel())
        again = keys[1:][keys[1:] == keys[:-1]]
        bits = np.zeros(1 << (BITS - power), np.uint8)
        bits[(again >> _U(40 - (BITS - power))).astype(np.int64)] = 1
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slices = docs.select("text").mapInArrow(entered, "bucket int, entries binary").groupBy("bucket").applyInArrow(twice, "bucket int, bits binary")
    out = np.zeros(1 << (BITS - 3), np.uint8)
    each = len(out) >> power
    # all slices together are as large as the bitmap
    for row in slices.collect():
        out[row["bucket"] * each : (row["bucket"] + 1) * each] = np.frombuffer(row["bits"], np.uint8)
    return out


class Shard(NamedTuple):
    """Distinct segments of a shard: their symbols, how often each stands in the corpus, and its smallest and greatest x."""

    symbols: np.ndarray
    offsets: np.ndarray
    copies: np.ndarray
    least: np.ndarray
    most: np.ndarray


class Marks(NamedTuple):
    """Runs of windows: the segment, the first window and the one after the last, and the x that places must exceed (None: all places)."""

    segment: np.ndarray
    first: np.ndarray
    end: np.ndarray
    above: np.ndarray | None


class Hits(NamedTuple):
    """Segments of a block whose minimiser may be repeated: first symbol and end, minimiser, row, place in the row, and name."""

    begin: np.ndarray
    end: np.ndarray
    seed: np.ndarray
    row: np.ndarray
    start: np.ndarray
    names: np.ndarray


_PARTS = ("payload", "sizes", "names", "copies", "least", "most")


def marks(docs: DataFrame, unit: Unit, engine: Callable[[Shard], Marks]) -> DataFrame:
    """x, y, begin and end of the symbols that the engine marks; docs has the columns x, y (longs that name the row) and text."""
    spark = docs.sparkSession
    size = text_size(docs, "text")
    bitmap: Broadcast = spark.sparkContext.broadcast(repeated_minimisers(docs, unit, size))
    shards = partitions_for(spark, size, unit.shard_bytes)
    own = docs.select("x", "y", "text")

    def hits(codes: np.ndarray, offsets: np.ndarray) -> Hits | None:
        bits = bitmap.value
        begin, end, seed = runs(codes, offsets, unit)
        bit = seed >> _U(64 - BITS)
        hit = np.flatnonzero((bits[(bit >> _U(3)).astype(np.int64)] >> (_U(7) - (bit & _U(7))).astype(np.uint8)) & 1)
        if not len(hit):
            return None
        begin, end = begin[hit], end[hit]
        row = np.searchsorted(offsets, begin, "right") - 1
        names = span_hashes(codes, begin, end, _words_pow if unit.words else _bytes_pow)
        return Hits(begin, end, seed[hit], row, begin - offsets[row], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            payload, sizes, names, shard, x = (np.concatenate([h[i] for h in held]) for i in range(5))
            _, first, kind = np.unique(names, return_index=True, return_inverse=True)
            copies = np.bincount(kind)
            least, most = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
            np.minimum.at(least, kind, x)
            np.maximum.at(most, kind, x)
            begin = np.cumsum(sizes) - sizes
            order = np.argsort(shard[first], kind="stable")
            used, cuts = np.unique(shard[first][order], return_index=True)
            rows: dict[str, list] = {p: [] for p in ("shard", *_PARTS)}
            symbols = payload.reshape(-1, unit.width)
            for s, a, b in zip(used.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                one = order[a:b]
                at = first[one]
                rows["shard"].append(s)
                rows["payload"].append(symbols[spread(begin[at], sizes[at])].tobytes())
                for p, values in (("sizes", sizes[at]), ("names", names[at]), ("copies", copies[one]), ("least", least[one]), ("most", most[one])):
                    rows[p].append(values.astype("<i4" if p == "sizes" else "<u8" if p == "names" else "<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), *(pa.array(rows[p], pa.binary()) for p in _PARTS)], names=["shard", *_PARTS])

        for batch in batches:
            for block in blocks(batch.column(2)):
                codes, offsets = unit.symbols(block)
                hit = hits(codes, offsets)
                if hit is None:
                    continue
                x = batch.column(0).slice(block.first, len(block)).to_numpy(zero_copy_only=False)[hit.row]
                size = hit.end - hit.begin
                held.append((unit.payload(block, codes, spread(hit.begin, size)), size, hit.names, (mix(hit.seed + _U(5)) % _U(shards)).astype(np.int64), x))
                weight += len(held[-1][0]) + 40 * len(size)
                if weight > 24 << 20:
                    yield flush()
                    held, weight = [], 0
        if held:
            yield flush()

    def judge(table: pa.Table) -> pa.Table:
        read = lambda part, kind: np.frombuffer(b"".join(table.column(part).to_pylist()), kind)
        size, names = read("sizes", "<i4").astype(np.int64), read("names", "<u8")
        raw = read("payload", np.uint8).reshape(-1, unit.width)
        names, first, kind = np.unique(names, return_index=True, return_inverse=True)
        begin = np.cumsum(size) - size
        if unit.words:
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, : unit.width] = raw
            symbols = wide.view("<u8").ravel()
        else:
            symbols = raw.ravel()
        symbols = symbols[spread(begin[first], size[first])]
        copies = np.zeros(len(first), np.int64)
        least, most = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
        np.add.at(copies, kind, read("copies", "<i8"))
        np.minimum.at(least, kind, read("least", "<i8"))
        np.maximum.at(most, kind, read("most", "<i8"))
        out = engine(Shard(symbols, np.r_[0, np.cumsum(size[first])], copies, least, most))
        above = pa.nulls(len(out.segment), pa.int64()) if out.above is None else pa.array(out.above, pa.int64())
        return pa.table({"name": pa.array(names[out.segment].view(np.int64), pa.int64()), "a": pa.array(out.first, pa.int64()), "b": pa.array(out.end - 1 + unit.length, pa.int64()), "above": above})

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                hit = hits(*unit.symbols(block))
                if hit is not None:
                    x, y = (batch.column(i).slice(block.first, len(block)).take(pa.array(hit.row)) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(hit.names.view(np.int64)), x, y, pa.array(hit.start, pa.int32())], names=["name", "x", "y", "start"])

    segments = own.mapInArrow(cut, "shard int, " + ", ".join(f"{p} binary" for p in _PARTS))
    marked = segments.groupBy("shard").applyInArrow(judge, "name long, a long, b long, above long")
    places = own.mapInArrow(stand, "name long, x long, y long, start int")
    found = places.join(marked, "name").where(F.col("above").isNull() | (F.col("x") > F.col("above")))
    return found.select("x", "y", (F.col("start") + F.col("a")).alias("begin"), (F.col("start") + F.col("b")).alias("end"))


def marked_runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one after the last index of each run of flags within one group."""
    on = np.r_[False, flags, False]
    same = np.r_[False, group[1:] == group[:-1]] if len(group) else np.zeros(0, bool)
    before = np.r_[False, flags[:-1]] & same if len(flags) else np.zeros(0, bool)
    opens = np.flatnonzero(flags & ~before)
    after = np.r_[flags[1:], False] & np.r_[same[1:], False] if len(flags) else np.zeros(0, bool)
    del on
    return opens, np.flatnonzero(flags & ~after) + 1


def with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with arrays `begins` and `ends` of its marks (null where it has none).

    Rows with the same x and y share one list without repetitions, made while they are
    still apart, so that any number of equal rows costs no more than one list each.
    """
    lists = found.groupBy("x", "y").agg(F.collect_set(F.struct("begin", "end")).alias("m")).select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("m.begin").alias("begins"), F.col("m.end").alias("ends"))
    return docs.join(lists, (docs["x"] == F.col("_x")) & (docs["y"] == F.col("_y")), "left").drop("_x", "_y")


def covered(begins: pa.Array, ends: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Which symbols of a block's rows are marked."""
    a, b = begins.fill_null([]) if begins.null_count else begins, ends.fill_null([]) if ends.null_count else ends
    counts = np.diff(np.asarray(a.offsets))
    row = np.repeat(np.arange(len(a)), counts)
    step = np.zeros(int(offsets[-1]) + 1, np.int64)
    np.add.at(step, np.asarray(a.flatten()) + offsets[row], 1)
    np.add.at(step, np.asarray(b.flatten()) + offsets[row], -1)
    return np.cumsum(step)[:-1] > 0
