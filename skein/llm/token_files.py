"""Token files compressed by a grammar: Re-Pair per shard, with expansion lengths for random access.

Documents are range-partitioned by id. A task encodes its documents, cuts their ids
into shards of bounded size at document ends, and replaces frequent pairs of ids by
nonterminals, round after round, never across a document's end, until no pair is
frequent or the symbols are used up. Where they are used up too early, wider symbols are tried. A shard's row holds
the rules, the length to which each rule expands, the shortened sequence, and for
each document where its symbols begin and how many ids they stand for; so one
document is read by expanding its own symbols alone.

Edge cases: a null or empty text has the end id alone; documents without an id come
first; repeated ids follow each other in the order of their texts; an empty table
gives no shard and no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import BLOCK_BYTES, spread, text_bytes
from .pieces import PieceCache, piece_bounds
from .tables import partitions_for, text_size

#: A pair is frequent if a shard has it so many times: a rule takes 8 bytes, and a replaced pair saves 2;
#: with symbols of 32 bits 12 and 4. With a vocabulary of 50,000 the 16-bit symbols, not this bound, end
#: the rounds of a full shard of prose.
FREQUENT = {16: 5, 32: 4}
#: Pairs found so many times are replaced first.
OFTEN = 32
#: Symbols of 32 bits are tried where the others have run out and at least this share of the places is
#: still in frequent pairs, as in many copies of long texts; they must then take fewer bytes.
STILL_FREQUENT = 0.75
#: Ids of a shard; a longer document has a shard of its own.
SHARD_IDS = 1 << 22
_CELL_BITS = 20
#: Pieces that are encoded end to end.
_TOGETHER = 4096
#: First bytes of white space beyond ASCII, and of other characters.
_MAYBE_WHITE = frozenset((0xC2, 0xE1, 0xE2, 0xE3))
#: Shards whose ids one task sums up.
_SHARDS = 4096


def symbol_bits(first_rule: int) -> int:
    """16 where the vocabulary leaves some thousands of symbols for nonterminals, else 32."""
    return 16 if first_rule <= (1 << 16) - (1 << 12) else 32

SHARD_SCHEMA = "part int, shard int, first_rule int, bits int, rules binary, expanded binary, symbols binary, doc_ids array<bigint>, doc_symbols array<bigint>, doc_ids_count array<bigint>"


class ByteBpe:
    """Ids of texts by a byte-level vocabulary; the tokenizers library encodes each distinct piece.

    Pieces of a blank and a word are encoded end to end, for a blank begins a piece
    whatever word stands before it; their ids are parted by the bytes they stand for.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # a byte-level token has a character for each byte
        self.token_bytes = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.token_bytes[i] = len(token)
        self.cache = PieceCache(self._pieces)

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        found: list[list[int]] = [[]] * len(pieces)
        words, apart = [], []
        for i, p in enumerate(pieces):
            (words if len(p) > 1 and p[0] == 0x20 < p[1] and p[1] not in _MAYBE_WHITE else apart).append(i)
        runs = [words[k : k + _TOGETHER] for k in range(0, len(words), _TOGETHER)]
        for run in runs:
            ids = self.tokenizer.encode_batch_fast([b"".join([pieces[i] for i in run]).decode()], add_special_tokens=False)[0].ids
            ends, stops = np.cumsum(self.token_bytes[ids]), np.cumsum([len(pieces[i]) for i in run])
            last = np.searchsorted(ends, stops)
            if last[-1] != len(ids) - 1 or (ends[last] != stops).any():
                apart += run
                continue
            cuts = (last + 1).tolist()
            for i, a, b in zip(run, [0, *cuts], cuts, strict=False):
                found[i] = ids[a:b]
        for i, e in zip(apart, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in apart], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def encode_many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as UTF-8 bytes and offsets, and the offsets of each text's ids."""
        raw = data.tobytes()
        if any(a.encode() in raw for a in self.added):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            runs = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *runs]), np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int64)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        place = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        rows = np.searchsorted(place, offsets)
        starts, ends = piece_bounds(points, rows, joined=True)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ids, sizes = self.cache.tokens(data, place[starts], place[ends])
        return ids, np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, rows)]


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def _cell(pair: np.ndarray) -> np.ndarray:
    if pair.dtype == np.uint64:
        return (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CELL_BITS)
    return (pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - _CELL_BITS)


def repair(ids: np.ndarray, ends: np.ndarray, first_rule: int, least: int | None = None, bits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), the shortened sequence, and where each document ends in it.

    ends: where each document ends in ids. A round counts neighbouring pairs that lie
    within a document, takes those found `least` times or more, most frequent first as
    far as symbols are left, and replaces every place whose pair is more frequent than
    the pairs overlapping it. Only places whose pair was frequent before, or that stand
    beside a new symbol, are counted again: all others have become rarer if anything.
    """
    bits = bits or symbol_bits(first_rule)
    least = least or FREQUENT[bits]
    # a symbol takes half of a pair
    seq, bounds = ids.astype(np.uint32 if bits == 16 else np.uint64), ends.astype(np.int64)
    # rare pairs wait until no other is left, which keeps the first rounds short
    rules, names, live, now = [], first_rule, None, max(least, OFTEN)
    while len(seq) > 1 and names < 1 << bits:
        half = seq.dtype.type(bits)
        if live is None:
            inside = np.ones(len(seq), bool)
            # the last place of a document has no neighbour
            inside[bounds[bounds > 0] - 1] = inside[-1:] = False
            live = np.flatnonzero(inside)
        pair = seq[live] << half | seq[live + 1]
        ranked = np.sort(pair)
        begin = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        kinds, count = ranked[begin], np.diff(np.r_[begin, len(ranked)])
        kinds, count = kinds[count >= now], count[count >= now]
        if not len(kinds):
            if now == least:
                break
            now, live = least, None
            continue
        # places of other pairs are left, but for some whose cell a frequent pair has
        cell, frequent = _cell(pair), np.zeros(1 << _CELL_BITS, bool)
        frequent[_cell(kinds)] = True
        heavy = frequent[cell]
        live, pair, cell = live[heavy], pair[heavy], cell[heavy]
        # rarest first, so that of pairs with one cell the most frequent has it; the others wait for the next round
        chosen = kinds[np.argsort(-count, kind="stable")[: (1 << bits) - names][::-1]]
        own = _cell(chosen)
        kind_at, weight_at = np.zeros(1 << _CELL_BITS, seq.dtype), np.zeros(1 << _CELL_BITS, np.int32)
        kind_at[own], weight_at[own] = chosen, np.arange(1, len(chosen) + 1)
        here = np.where(kind_at[cell] == pair, weight_at[cell], 0)
        weight = np.zeros(len(seq) + 2, np.int32)
        weight[live + 1] = here
        # of two overlapping places the more frequent pair goes first; of equals, as in a run of one id, the left one
        won = (here > 0) & (here > weight[live]) & (here >= weight[live + 2])
        take = live[won]
        present = np.bincount(here[won], minlength=len(chosen) + 1) > 0
        used, slot = np.flatnonzero(present), (np.cumsum(present) - 1)[here[won]]
        rules.append(chosen[used - 1])
        seq[take] = names + slot
        stays = np.ones(len(seq), bool)
        stays[take + 1] = False
        bounds = bounds - np.searchsorted(take + 1, bounds)
        open_ = np.zeros(len(seq), bool)
        open_[live] = True
        seq = seq[stays]
        names += len(used)
        # the new symbols' places, after what stood before them has gone
        fresh = take - np.arange(len(take))
        open_ = open_[stays]
        open_[np.maximum(fresh - 1, 0)] = True
        open_[bounds[bounds > 0] - 1] = open_[-1:] = False
        live = np.flatnonzero(open_)
    flat = np.concatenate(rules) if rules else np.zeros(0, seq.dtype)
    return np.stack([flat >> flat.dtype.type(bits), flat & flat.dtype.type((1 << bits) - 1)], 1), seq, bounds


def _frequent_share(seq: np.ndarray, bounds: np.ndarray, least: int) -> float:
    """The share of neighbouring 16-bit symbols within documents whose pair is found `least` times or more."""
    pairs = np.delete(seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:].astype(np.uint32), np.unique(bounds[(bounds > 0) & (bounds < len(seq))]) - 1)
    _, counts = np.unique(pairs, return_counts=True)
    return float(counts[counts >= least].sum()) / max(1, len(pairs))


def compressed(ids: np.ndarray, ends: np.ndarray, first_rule: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of a symbol, rules, sequence and document ends: of narrow and wide symbols those that take fewer bytes, where both are worth trying."""
    bits = symbol_bits(first_rule)
    rules, seq, bounds = repair(ids, ends, first_rule, bits=bits)
    if bits == 16 and first_rule + len(rules) >= 1 << 16 and _frequent_share(seq, bounds, FREQUENT[32]) >= STILL_FREQUENT:
        wide = repair(ids, ends, first_rule, bits=32)
        if 12 * len(wide[0]) + 4 * len(wide[1]) < 8 * len(rules) + 2 * len(seq):
            return 32, *wide
    return bits, rules, seq, bounds


def expanded_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """To how many ids each rule expands; a rule names only ids and earlier rules."""
    sizes: list[int] = []
    for a, b in rules.tolist():
        sizes.append((1 if a < first_rule else sizes[a - first_rule]) + (1 if b < first_rule else sizes[b - first_rule]))
    return np.array(sizes, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int, sizes: np.ndarray) -> np.ndarray:
    """The ids that a run of symbols stands for; sizes are the rules' expansion lengths."""
    # what each rule stands for, one rule after another; a round writes those whose two parts are known
    size = np.r_[np.ones(first_rule, np.int64), sizes]
    start = np.r_[np.arange(first_rule), first_rule + np.cumsum(sizes) - sizes].astype(np.int64)
    table = np.r_[np.arange(first_rule), np.zeros(int(sizes.sum()), np.int64)].astype(np.uint32)
    left, right = rules.astype(np.int64).reshape(-1, 2).T
    known, open_ = size == 1, np.arange(len(rules))
    while len(open_):
        ready = known[left[open_]] & known[right[open_]]
        now = open_[ready]
        for part, to in ((left[now], start[first_rule + now]), (right[now], start[first_rule + now] + size[left[now]])):
            table[spread(to, size[part])] = table[spread(start[part], size[part])]
        known[first_rule + now] = True
        open_ = open_[~ready]
    return table[spread(start[symbols], size[symbols])]


def _kind(bits: int) -> str:
    return "<u2" if bits == 16 else "<u4"


def _shard(part: int, shard: int, ids: list[np.ndarray], sizes: list[np.ndarray], docs: list[int | None], first_rule: int) -> list:
    flat, counts = np.concatenate(ids), np.concatenate(sizes)
    bits, rules, seq, bounds = compressed(flat, np.cumsum(counts), first_rule)
    kind = _kind(bits)
    return [part, shard, first_rule, bits, rules.astype(kind).tobytes(), expanded_lengths(rules, first_rule).astype("<u4").tobytes(), seq.astype(kind).tobytes(), docs, np.r_[0, bounds[:-1]].tolist(), counts.tolist()]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, part_bytes: int = 16 << 20) -> None:
    """Write the ids of all documents, each closed by end_id, as grammar-compressed shards in ascending doc_id order."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = partitions_for(docs.sparkSession, text_size(plain, "text"), part_bytes)
    arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_rule", pa.int32()), ("bits", pa.int32()), ("rules", pa.binary()), ("expanded", pa.binary()), ("symbols", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int64())), ("doc_ids_count", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, shard = coder(vocabulary), TaskContext.get().partitionId(), 0
        ids, sizes, names, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            made = _shard(part, shard, ids, sizes, names, own.size)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            keys, at = batch.column(0).to_pylist(), 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 2 * BLOCK_BYTES, "right")) - 1)
                got, bounds = own.encode_many(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                count = np.diff(bounds) + 1
                closed = np.full(int(count.sum()), end_id, np.int32)
                inner = np.ones(len(closed), bool)
                inner[np.cumsum(count) - 1] = False
                closed[inner] = got
                if held and held + len(closed) > SHARD_IDS:
                    yield row()
                    shard, ids, sizes, names, held = shard + 1, [], [], [], 0
                ids.append(closed)
                sizes.append(count)
                names += keys[at:to]
                held += len(closed)
                at = to
        if held:
            yield row()

    plain.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and token_ids of every document in the files."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row a shard; within runs of parts the sums are taken apart, and only the runs' own sums are added up in one place
    totals = shards.select("part", "shard", F.aggregate("doc_ids_count", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).withColumn("run", F.floor(F.col("part") / _SHARDS))
    runs = totals.groupBy("run").agg(F.sum("n").alias("all")).select("run", (F.sum("all").over(Window.orderBy("run")) - F.col("all")).alias("run_start"))
    inside = totals.withColumn("inside", F.sum("n").over(Window.partitionBy("run").orderBy("part", "shard")) - F.col("n"))
    starts = inside.join(F.broadcast(runs), "run").select("part", "shard", (F.col("run_start") + F.col("inside")).alias("shard_start"))  # a row for each 4096 parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind = _kind(row["bits"])
                rules = np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.int64)
                ids = expand(np.frombuffer(row["symbols"], kind), rules, row["first_rule"], np.frombuffer(row["expanded"], "<u4").astype(np.int64)).astype("<u4", copy=False)
                counts = np.array(row["doc_ids_count"], np.int64)
                to = np.cumsum(counts)
                raw = ids.tobytes()
                spans = list(zip((to - counts).tolist(), to.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["shard_start"] + to - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, to], pa.int32()), pa.array(ids.astype(np.int32), pa.int32())),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"],
                )

    return shards.join(starts, ["part", "shard"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, token_ids array<int>")


def read_document(shard: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of one shard row, from its own symbols and the rules they lead to alone."""
    kind = _kind(shard["bits"])
    rules = np.frombuffer(shard["rules"], kind).reshape(-1, 2).astype(np.int64)
    symbols = np.frombuffer(shard["symbols"], kind)
    at = shard["doc_symbols"]
    sizes = np.frombuffer(shard["expanded"], "<u4").astype(np.int64)
    first, own = shard["first_rule"], symbols[at[k] : at[k + 1] if k + 1 < len(at) else len(symbols)].astype(np.int64)
    used, fresh = np.zeros(len(rules), bool), np.unique(own[own >= first]) - first
    while len(fresh):
        used[fresh] = True
        named = np.unique(rules[fresh])
        fresh = named[named >= first] - first
        fresh = fresh[~used[fresh]]
    # the rules in use, numbered anew
    names = first + np.cumsum(used) - 1
    renamed = lambda x: np.where(x < first, x, names[np.maximum(x - first, 0)]) if len(names) else x
    return expand(renamed(own), renamed(rules[used]), first, sizes[used])
