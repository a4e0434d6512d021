"""Best-fit packing of all documents' tokens into sequences, planned from the counts of lengths.

A task encodes its documents, closes each with the end id, cuts those longer than a
sequence (the first piece may be shorter, all others are full), and numbers its pieces
of each length. How many pieces of each length a task has is summed up over the tasks
before it; with that a piece's number among all pieces of its length is known without
gathering them. `configurations.plan` packs the counts of lengths, as many numbers as a
sequence has tokens. Its fillings say, for each run of numbers of a length, which
sequences they go to and where; this table is as bounded as the plan, is sent to all
tasks, and a piece finds its place there by its length and number.

Edge cases: a null or empty text is the end id alone; rows that share an id or have none
are packed each on its own, equal rows too; which of the equally long pieces takes which
of their places is arbitrary; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BLOCK_BYTES, text_bytes
from .configurations import Filling, plan
from .tables import stored
from .token_files import coder

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part and nth (the task, and the number among its pieces of this length); with ids also token_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = coder(vocabulary), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            names, at = batch.column(0), 0
            while at < len(names):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 2 * BLOCK_BYTES, "right")) - 1)
                got, bounds = own.encode_many(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                total = np.diff(bounds) + 1
                tokens = np.insert(got, bounds[1:], end_id)
                many = -(-total // capacity)
                row = np.repeat(np.arange(to - at), many)
                nth_piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                first = total - (many - 1) * capacity
                begin = np.where(nth_piece > 0, first[row] + (nth_piece - 1) * capacity, 0)
                length = np.where(nth_piece > 0, capacity, first[row])
                # the number among equal lengths: those of earlier blocks, and those before it here
                order = np.argsort(length, kind="stable")
                kinds, opens, count = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(opens, count) + np.repeat(met[kinds], count)
                met[kinds] += count
                where = (np.cumsum(total) - total)[row] + begin
                raw = np.ascontiguousarray(tokens, "<u4").tobytes()
                out = [
                    names.slice(at, to - at).take(pa.array(row)), pa.array(nth_piece, pa.int32()), pa.array(begin), pa.array(length),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(where.tolist(), (where + length).tolist(), strict=True)], pa.int64()),
                    pa.array(np.full(len(row), part, np.int64)), pa.array(nth),
                ]
                if ids:
                    # pieces stand one after another in their documents' order
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[where, len(tokens)], pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["token_ids"] if ids else [])])
                at = to

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, _PIECE + (", token_ids array<int>" if ids else ""))


def places(fillings: list[Filling], capacity: int) -> dict[str, np.ndarray]:
    """For runs of numbers of one length, sorted by length and number: where the run begins, its first sequence, how many a sequence takes, and from which offset."""
    runs: list[tuple[int, int, int, int, int]] = []
    met, sequence = np.zeros(capacity + 1, np.int64), 0
    for f in fillings:
        offset = 0
        for length, many in f.parts:
            runs.append((length, int(met[length]), sequence, many, offset))
            met[length] += f.count * many
            offset += length * many
        sequence += f.count
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "many", "offset"), table.T, strict=True))


def placed(made: DataFrame, capacity: int = 2048, groups: int = 64) -> DataFrame:
    """Stored pieces with sequence_id and offset. Sequences are filled from 0 without gaps; all pieces go into as few as the plan needs."""
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = np.zeros(capacity + 1, np.int64)
    # a row for each length, capacity of them at most
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        totals[row["length"]] = row["n"]
    table = places(plan(totals, capacity, groups), capacity)
    # where each length's runs begin; numbers within a length are sorted
    opens = np.searchsorted(table["length"], np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.zeros(len(length), np.int64)
            for kind in np.unique(length).tolist():
                here = length == kind
                a, b = opens[kind], opens[kind + 1]
                at[here] = a + np.searchsorted(table["first"][a:b], number[here], "right") - 1
            sequence, turn = np.divmod(number - table["first"][at], table["many"][at])
            added = [pa.array(sequence + table["sequence"][at]), pa.array(table["offset"][at] + turn * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, c in enumerate(batch.schema.names) if c != "number"), *added], names=[*(c for c in batch.schema.names if c != "number"), "sequence_id", "offset"])

    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    kept = [f for f in made.schema if f.name not in ("part", "nth")]
    numbered = made.join(before, ["part", "length"]).select(*(f.name for f in kept), (F.col("before") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "sequence_id long", "offset long"]))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, groups: int = 64, ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset; with ids also token_ids."""
    # written once: numbers within a task must not change between the count and the placing
    return placed(stored(pieces(docs, vocabulary, capacity, end_id, ids), "pieces"), capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, token_ids, and doc_ids and lengths of its pieces in order; a sequence's pieces have `capacity` tokens together at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "token_ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.token_ids").alias("token_ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
