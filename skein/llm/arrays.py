"""Whole-batch text helpers: words, windows and hashes of an Arrow batch of texts, in numpy.

A batch of texts is one byte array and the offsets of its rows, so that no step
loops over rows, words or bytes in Python. Hashes are 64-bit polynomials over
the ring of integers mod 2**64, taken from prefix sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of tokens of letters and digits; every byte of a non-ASCII character counts as one.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class _Powers:
    """Growing tables of base**i and base**-i mod 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[_U(1), np.full(size - 1, self.base, _U)], dtype=_U)
                self.down = np.cumprod(np.r_[_U(1), np.full(size - 1, self.inverse, _U)], dtype=_U)
        return self.up[:n], self.down[:n]


_bytes_pow, _words_pow = _Powers(_BASE | 1), _Powers(_WORD_BASE | 1)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = _bytes_pow) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each span; equal spans have equal hashes wherever they stand."""
    up, down = powers.upto(len(codes) + 1)
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def window_hashes(codes: np.ndarray, k: int, powers: _Powers = _words_pow) -> np.ndarray:
    """Hashes of every run of k codes, by start; crossing runs are the caller's to drop."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = powers.upto(len(codes) + 1)
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for as many as counts has, one run after another."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)


def within(offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of k positions that lie inside one row."""
    return spread(offsets[:-1], np.maximum(np.diff(offsets) - k + 1, 0))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each position."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Block:
    """Texts of some rows of a batch: their bytes, and where each row's begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, lower: bool = False, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends and hashes of all words, and each row's first word.

        A word is a run of bytes other than the six ASCII white-space bytes; with
        letters, a run of ASCII letters, digits and non-ASCII bytes. lower folds A-Z.
        """
        data = _LOWER[self.data] if lower else self.data
        inside = _ALNUM[data] if letters else ~_SPACE[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        rows = self.offsets[:-1][self.offsets[:-1] < len(data)]
        opens = inside.copy()
        opens &= ~before[:-1]
        opens[rows] = inside[rows]
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        closes = inside & ~after[1:]
        last = rows[rows > 0] - 1
        closes[last] = inside[last]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return starts, ends, span_hashes(byte_codes(data), starts, ends), np.searchsorted(starts, self.offsets)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's rows in blocks of about `most` bytes, whole rows each."""
    data, offsets = text_bytes(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield Block(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column from bytes and offsets, without a loop."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
