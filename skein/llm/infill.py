"""Fill-in-middle: texts cut in three at unit bounds drawn from the id, by a two-pass streaming matcher.

The first pass over a text only counts its units (matches of a pattern). Two ranks are
drawn from the hash of seed and id. The second pass starts a new lazy match iterator and
advances it to the smaller rank and then to the larger one; the ends of the two matches
are where prefix and middle end. No list of units, matches or offsets is kept, so that
beyond the text itself memory does not grow with it.

A text is written as it is (plain), as prefix, suffix, middle (psm) or as suffix, prefix,
middle (spm), each part after its marker. `restored` undoes this exactly with built-in
functions: markers have no part of another at their ends, and texts that hold a marker
stay plain, so each marker's first place is the written one.

Edge cases: a null text is an empty one, and an empty text is plain; a text without any
match has no units, and all of it is suffix; white space counts like any other text;
rows that share an id are cut at the same fractions, each on its own; a null id counts
as the empty string; an empty table gives no rows. Columns of the input that have the
name of an added one are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import BLOCK_BYTES, text_bytes

#: A line with its end, or what is left after the last one.
LINES = r"[^\n]*\n|[^\n]+"
_ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


class Markers(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def checked(self) -> Markers:
        """self, if a marker can be told from all that may stand beside it."""
        for a in self:
            if not a or any(b.startswith(a[-k:]) for b in self for k in range(1, len(a))) or any(a in b and a is not b for b in self):
                raise ValueError(f"marker {a!r} is empty or overlaps another or itself")
        return self


class Cut(NamedTuple):
    units: int
    prefix_end: int
    middle_end: int


def drawn(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for an id: the leading groups of 8 digits of a sha256."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))  # type: ignore[return-value]


def cut(text: str, units: re.Pattern[str], first: int, second: int) -> Cut:
    """How many units a text has, and where the smaller and the larger of the two drawn ranks end in it."""
    n = sum(1 for _ in units.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    found, a = units.finditer(text), 0
    if low:
        a = next(islice(found, low - 1, None)).end()
    return Cut(n, a, next(islice(found, high - low - 1, None)).end() if high > low else a)


def transform(docs: DataFrame, pattern: str = LINES, seed: int = 7, share: int = 100, spm_share: int = 50, markers: Markers = Markers()) -> DataFrame:
    """docs with n (units), form, prefix_chars and middle_chars (null if plain) and output.

    share: per cent of the texts to transform; spm_share: per cent of those in spm form.
    """
    marks = markers.checked()
    kept = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    own = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), _ADDED])
    text_at, id_at = kept.index("text"), kept.index("doc_id")

    def one(doc_id: object, text: str, units: re.Pattern[str]) -> tuple:
        h = drawn(seed, doc_id)
        c = cut(text, units, h[0], h[1])
        if not text or h[2] % 100 >= share or any(m in text for m in marks):
            return c.units, "plain", None, None, text
        before, middle, after = text[: c.prefix_end], text[c.prefix_end : c.middle_end], text[c.middle_end :]
        if h[3] % 100 < spm_share:
            form, out = "spm", "".join((marks.suffix, after, marks.prefix, before, marks.middle, middle))
        else:
            form, out = "psm", "".join((marks.prefix, before, marks.suffix, after, marks.middle, middle))
        return c.units, form, c.prefix_end, c.middle_end - c.prefix_end, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = re.compile(pattern)
        for batch in batches:
            _, offsets = text_bytes(batch.column(text_at))
            row = 0
            # a few megabytes of text at a time; a longer text is a batch of its own
            while row < batch.num_rows:
                to, size = row + 1, offsets[row + 1] - offsets[row]
                while to < batch.num_rows and size + offsets[to + 1] - offsets[to] <= 2 * BLOCK_BYTES:
                    size += offsets[to + 1] - offsets[to]
                    to += 1
                piece = batch.slice(row, to - row)
                made = [one(d, t or "", units) for d, t in zip(piece.column(id_at).to_pylist(), piece.column(text_at).to_pylist(), strict=True)]
                added = [pa.array(x, k) for x, k in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*piece.columns, *added], names=[*kept, "n", "form", "prefix_chars", "middle_chars", "output"])
                row = to

    return own.mapInArrow(run, schema)


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that an output was made of."""
    opening = {"psm": (markers.prefix, markers.suffix), "spm": (markers.suffix, markers.prefix)}

    def parts(kind: str) -> tuple[Column, Column, Column]:
        first, second = opening[kind]
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(output))
        two = F.substring_index(rest, markers.middle, 1)
        return one, two, F.substring(rest, F.length(two) + len(markers.middle) + 1, F.length(output))

    before, after, middle = parts("psm")
    tail, head, inner = parts("spm")
    return F.when(form == "psm", F.concat(before, middle, after)).when(form == "spm", F.concat(head, inner, tail)).otherwise(output)
