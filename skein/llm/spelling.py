"""Grouping spelling variants: words one code point apart, found without listing pairs.

Words are counted over all texts. For replacements each word enters one wildcard group
for each of its places, named by (place, what stands before, what stands after); all
other members of a group differ from it in that one place, and no two groups of a word
share another member. So a group's size less one is added to the word's count of near
words, and of a group only the two best words matter: every member's best is the first,
the first's own best is the second. For insertions and deletions the texts left by
deleting one code point are joined to the vocabulary; equal deletions of a word (in runs
of one letter) are taken once. Both kinds are summed by word; pairs of words inside a
group are never made. A group has at most as many members as the pattern has letters.

A word's form is its best near word, that with the largest count (ties: the smallest in
code-point order), if that count is `factor` times its own or more. Counts at least
double along forms (factor 2), so chains are short and cannot close; roots are found by
pointer doubling.

Names of groups and of deletions have 128 bits (two polynomial hashes), taken for what
they name. They are computed from prefix sums, so that a word of any length costs as
many rows of fixed size as it has code points.

Edge cases: null and empty texts have no runs; a null id counts as the empty string in
the noise rule; rows that share an id or a text count each; an empty table, or one
without words frequent enough, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import _bytes_pow, _words_pow, mix, row_of
from .tables import materialize, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maximal runs of these letters are words.
RUN = "[A-Za-zÀ-ÿ]+"
#: Code points whose variants are made at once.
_AT_ONCE = 1 << 19

_U = np.uint64
_NAMED = "a long, b long, id long, n long"


def damaged(run: Column, doc_id: Column, modulus: int) -> Column:
    """run, less one code point where modulus divides the crc32 of `<doc_id>:<run>`; that number also says which."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, pattern: str = RUN, modulus: int | None = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """word and n, how often it is found, for words of `shortest` code points or more found `least` times or more.

    Only A-Z are folded. modulus: runs are damaged as `damaged` says, None: not at all.
    """
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("run"))
    word = damaged(F.col("run"), F.col("doc_id"), modulus) if modulus else F.col("run")
    counted = runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def numbered(vocabulary: DataFrame) -> DataFrame:
    """id, word and n; ids ascend in code-point order of the words."""
    parts = max(1, int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = vocabulary.repartitionByRange(parts, "word").sortWithinPartitions("word")
    # written once: a second run of the sampling could draw other bounds and give other ids
    return stored(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


class _Hashes:
    """Polynomial hashes of pieces of many words, for two bases."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray) -> None:
        self.row = row_of(offsets)
        self.start, self.end = offsets[:-1], offsets[1:]
        self.sides = []
        for powers, salt in ((_bytes_pow, 1), (_words_pow, 2)):
            up, down = powers.upto(len(points) + 2)
            codes = mix((points.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(salt))
            total = np.zeros(len(points) + 1, _U)
            np.cumsum(codes * up[: len(points)], out=total[1:])
            self.sides.append((total, down))

    def whole(self) -> list[np.ndarray]:
        size = (self.end - self.start).astype(_U)
        return [mix((t[self.end] - t[self.start]) * down[self.start] + size) for t, down in self.sides]

    def without(self, at: np.ndarray) -> list[np.ndarray]:
        """Of the word without the code point at each place; equal to `whole` of that shorter word."""
        s, e = self.start[self.row[at]], self.end[self.row[at]]
        size = (e - s - 1).astype(_U)
        return [mix((t[at] - t[s]) * down[s] + (t[e] - t[at + 1]) * down[s + 1] + size) for t, down in self.sides]

    def wildcard(self, at: np.ndarray) -> list[np.ndarray]:
        """Of the place, what stands before it and what stands after it."""
        s, e = self.start[self.row[at]], self.end[self.row[at]]
        where = mix((at - s).astype(_U) + _U(77)) + (e - s).astype(_U)
        return [mix((t[at] - t[s] + t[e] - t[at + 1]) * down[s] + where) for t, down in self.sides]


def _named(vocabulary: DataFrame, what: str) -> DataFrame:
    """a, b (a name of 128 bits), id and n: of each word itself, of its wildcard groups or of its distinct deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends, row = np.cumsum(sizes), 0
            while row < len(texts):
                to = max(row + 1, int(np.searchsorted(ends, ends[row] - sizes[row] + _AT_ONCE, "right")))
                points = np.frombuffer("".join(texts[row:to]).encode("utf-32-le"), np.uint32)
                offsets = np.r_[0, np.cumsum(sizes[row:to])]
                h = _Hashes(points, offsets)
                if what == "word":
                    owner, names = np.arange(to - row), h.whole()
                else:
                    at = np.arange(len(points))
                    if what == "deletion":
                        fresh = np.r_[True, points[1:] != points[:-1]][: len(points)]
                        fresh[offsets[:-1]] = True
                        at = at[fresh]
                    owner, names = h.row[at], h.wildcard(at) if what == "wildcard" else h.without(at)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in names), pa.array(ids[row:to][owner]), pa.array(counts[row:to][owner])], names=["a", "b", "id", "n"])
                row = to

    return vocabulary.select("id", "word", "n").mapInArrow(run, _NAMED)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """id, n_near (how many words are one code point away), and best_n and best of the best of them; words with none are left out."""
    group = Window.partitionBy("a", "b")
    ranked = group.orderBy(F.col("n").desc(), "id")
    top = lambda rank: F.nth_value(F.struct("n", (-F.col("id")).alias("back")), rank).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    members = _named(vocabulary, "wildcard").select("id", F.count("*").over(group).alias("size"), F.row_number().over(ranked).alias("rank"), top(1).alias("first"), top(2).alias("second"))
    replaced = members.where("size > 1").select("id", (F.col("size") - 1).alias("others"), F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first")).alias("best"))
    shorter = _named(vocabulary, "word").select("a", "b", F.col("id").alias("short"), F.col("n").alias("short_n"))
    met = _named(vocabulary, "deletion").join(shorter, ["a", "b"])
    side = lambda of, n, other: F.struct(F.col(of).alias("id"), F.lit(1).cast("long").alias("others"), F.struct(F.col(n).alias("n"), (-F.col(other)).alias("back")).alias("best"))
    indels = met.select(F.inline(F.array(side("id", "short_n", "short"), side("short", "n", "id"))))
    summed = replaced.unionByName(indels).groupBy("id").agg(F.sum("others").alias("n_near"), F.max("best").alias("best"))
    return summed.select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.back")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root: where the forms (id, to) of each lead in the end. One round a doubling of the longest chain."""
    links = materialize(forms.select("id", "to"))
    while True:
        ahead = links.select(F.col("id").alias("to"), F.col("to").alias("further"))
        links = materialize(links.join(ahead, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        moved = links.where("moved").limit(1).count()
        links = links.select("id", "to")
        if not moved:
            return links.select("id", F.col("to").alias("root"))


def variants(docs: DataFrame, pattern: str = RUN, modulus: int | None = 97, shortest: int = 5, least: int = 3, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word frequent enough (see the module's docstring)."""
    own = docs.select("doc_id", "text")
    vocabulary = numbered(words(own, pattern, modulus, shortest, least))
    near = vocabulary.join(near_words(vocabulary), "id", "left")
    taken = F.col("best_n") >= factor * F.col("n")
    judged = stored(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("to"), F.when(taken, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(judged.where("to IS NOT NULL"))
    name = lambda key, column: judged.select(F.col("id").alias(key), F.col("word").alias(column))
    out = judged.join(ends, "id", "left").join(name("to", "form"), "to", "left").join(name("root", "root_word"), "root", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
