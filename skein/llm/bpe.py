"""Byte-pair encoding by backtracking over longest matches, and decoding through an offset table.

An Aho-Corasick automaton over the vocabulary gives, for each position of a word,
the longest token that starts there. Tokens are taken greedily; whenever a token
may not follow the one before it (merging the two texts together would not leave
them apart), a shorter one is tried, and when none is left the encoder goes back a
step. A position found to lead nowhere is not tried again, so the work is linear in
the word. A sequence whose neighbours are all compatible is the one that the merges
give; compatibility is kept in a table of pairs.

Edge cases: a null or empty text, or one of white space alone, has no ids and an
empty decoded text. Ties cannot occur (an encoding is unique); repeated rows are
encoded each on its own; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BLOCK_BYTES, text_bytes
from .pieces import PieceCache, piece_bounds

#: Added to the byte value of a word's last symbol, which carries the word end.
_END = 256


def _byte_letters() -> dict[str, int]:
    """The printable letters that vocabularies of this kind use for the 256 byte values."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder for a BPE vocabulary file whose last symbols carry a word end."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()

        def symbols(token: str) -> str:
            closed = token.endswith(end) and len(token) > len(end)
            codes = [letters[c] for c in (token[: -len(end)] if closed else token)]
            if closed:
                codes[-1] += _END
            return "".join(map(chr, codes))

        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = dict(model["vocab"])
        self.ids = {symbols(t): i for t, i in names.items()}
        self.rank: dict[tuple[str, str], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((symbols(a), symbols(b)), r)
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            self.automaton.add_word(t[::-1], len(t))
        self.automaton.make_automaton()
        size = max([*names.values(), *self.added.values()]) + 1
        table = [b""] * size
        for t, i in [*names.items(), *self.added.items()]:
            table[i] = t.encode() + b" "
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.at = np.r_[0, np.cumsum([len(t) for t in table])].astype(np.int64)
        self.cache = PieceCache(self._encode_pieces)

    def merged(self, text: str) -> list[str]:
        """The tokens that the merges leave of a short text: what the compatibility table is filled from."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges of left and right put together end in just these two tokens."""
        key = (left, right)
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            ok = self.fits[key] = self.merged(left + right) == [left, right]
        return ok

    def reachable(self, token: str) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.merged(token) == [token]
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word, given as its bytes."""
        text = "".join(map(chr, word[:-1])) + chr(word[-1] + _END)
        if self.reachable_word(text):
            return [self.ids[text]]
        n, back = len(text), text[::-1]
        longest = [1] * n
        # read backwards, a match that ends at a place starts there in reading order; the longest comes first
        for stop, size in self.automaton.iter(back):
            start = n - 1 - stop
            if size > longest[start]:
                longest[start] = size
        dead, taken, ends, size = bytearray(n + 1), [], [0], longest[0]
        while ends[-1] < n:
            at = ends[-1]
            while size:
                token = text[at : at + size]
                if not dead[at + size] and token in self.ids and (self.compatible(taken[-1], token) if taken else self.reachable(token)):
                    break
                size -= 1
            if size:
                taken.append(token)
                ends.append(at + size)
                size = longest[at + size] if at + size < n else 0
            else:
                if not taken:
                    return [self.ids[t] for t in self.merged(text)]
                dead[at] = 1
                ends.pop()
                size = len(taken.pop()) - 1
        return [self.ids[t] for t in taken]

    def reachable_word(self, text: str) -> bool:
        return text in self.ids and self.reachable(text)

    def _encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.encode_word(p) for p in pieces]

    @staticmethod
    def normalized(text: str) -> str:
        """Composed, and lower case character by character."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # the one capital whose lower case, as str.lower has it, depends on its place in a word
        return text.replace("Σ", "σ").lower()

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens, and where each text's begin."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        starts, ends = piece_bounds(points, offsets, joined=False)
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        place = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        ids, sizes = self.cache.tokens(data, place[starts], place[ends]) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        total = np.r_[0, np.cumsum(sizes)]
        return ids, total[np.searchsorted(starts, offsets)]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and the offsets of each text's."""
        if not any(a in t for a in self.added for t in texts):
            return self._plain([self.normalized(t) for t in texts])
        import re

        cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        parts, owner, fixed = [], [], []
        for row, t in enumerate(texts):
            for part in cut.split(t):
                parts.append("" if part in self.added else self.normalized(part))
                fixed.append(self.added.get(part))
                owner.append(row)
        ids, offsets = self._plain(parts)
        runs = [ids[offsets[i] : offsets[i + 1]] if fixed[i] is None else np.array([fixed[i]], np.int32) for i in range(len(parts))]
        sizes = np.bincount(owner, [len(r) for r in runs], len(texts)).astype(np.int64)
        return (np.concatenate(runs) if runs else ids), np.r_[0, np.cumsum(sizes)]

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded texts and their offsets: tokens with a blank between, copied out of one table."""
        sizes = self.at[ids + 1] - self.at[ids]
        total = np.r_[0, np.cumsum(sizes)]
        data = self.table[np.repeat(self.at[ids] - total[:-1], sizes) + np.arange(total[-1])]
        bounds = total[offsets]
        keep = np.ones(len(data), bool)
        keep[bounds[1:][np.diff(bounds) > 0] - 1] = False  # the blank after a text's last token
        return data[keep], bounds - np.r_[0, np.cumsum(np.diff(bounds) > 0)]


_coders: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """The vocabulary, read once in a Python worker."""
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


def _text_slices(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    _, offsets = text_bytes(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


def encode(docs: DataFrame, vocabulary: str, text: str = "text", tokens: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each whole text in `tokens`, and in `decoded`, if named, the text that these ids decode to."""
    added = [f"{tokens} array<int>"] + ([f"{decoded} string"] if decoded else [])
    kept = [c for c in docs.columns if c not in (tokens, decoded)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in kept)).schema), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            column = batch.column(kept.index(text))
            for a, b in _text_slices(column):
                ids, offsets = own.encode_many([t or "" for t in column.slice(a, b - a).to_pylist()])
                out = [*batch.slice(a, b - a).columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    data, bounds = own.decode_many(ids, offsets)
                    out.append(pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]))
                yield pa.RecordBatch.from_arrays(out, names=[*kept, tokens, *([decoded] if decoded else [])])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: str, tokens: str = "token_ids", text: str = "decoded") -> DataFrame:
    """coded with the text that its ids stand for."""
    kept = [c for c in coded.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*(F.col(f"`{c}`") for c in kept)).schema), f"{text} string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(kept.index(tokens)).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            data, bounds = own.decode_many(np.concatenate([np.zeros(0, np.int64), *lists]), offsets)
            made = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*kept, text])

    return coded.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of each text's ids and of what they decode to.

    The ids go through encode_many and decode_many as in `encode`; only their digests
    leave the Python workers, so that nothing as large as the texts moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            column = batch.column(1)
            for a, b in _text_slices(column):
                ids, offsets = own.encode_many([t or "" for t in column.slice(a, b - a).to_pylist()])
                data, bounds = own.decode_many(ids, offsets)
                raw, cooked = ids.astype("<u4").tobytes(), data.tobytes()
                at, to = offsets.tolist(), bounds.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array([hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in range(b - a)]),
                        pa.array([hashlib.sha256(cooked[to[i] : to[i + 1]]).hexdigest() for i in range(b - a)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(spark: SparkSession, name: str) -> str:
    """Where a public vocabulary file lies on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
