"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Each document has counts taken from its whole text, and from these a few ratios. A
rule rejects beyond a cutoff. Cutoffs stand on fixed ladders from lenient to strict;
per stratum and rule, labelled good documents say how many each step would reject,
and the exact binomial tail decides whether its false rejections are below the
allowed share. Steps are tested in order and the first that fails ends the climb, so
no correction is needed along a ladder; over rules and strata the error is divided
(Bonferroni). With `joint`, as the queries use it, all rules of a stratum climb
together: step i is the set rejected by any rule at its i-th cutoff, the sets grow with
i, and each is tested at the whole share, so that only the strata divide the risk. A
stratum with too few labels has no rule.

Edge cases: a null, empty or blank text has no words and fails the base rule; ties on
a cutoff are kept; a missing stratum is one of its own; a label without a document or
with a null grade is not used; repeated documents count as often as they stand there;
without labels only the base rule acts; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Block, blocks, byte_codes, row_of, span_hashes, sums_by_row, window_hashes, within
from .tables import aside, materialize

#: Share of good documents that all rules of a stratum together may reject, and the risk that the share is exceeded.
FALSE_REJECTIONS, RISK = 0.01, 0.05
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

#: Ratio and its ladder of cutoffs, lenient first; a document is rejected above the cutoff (for short words: below).
LADDERS: dict[str, list[float]] = {
    "symbol_ratio": [round(0.30 - 0.01 * i, 4) for i in range(30)],
    "dup_line_ratio": [round(0.90 - 0.03 * i, 4) for i in range(30)],
    "repeat_ratio": [round(0.49 - 0.016 * i, 4) for i in range(30)],
    "long_words": [round(20 - 0.4 * i, 4) for i in range(30)],
    "short_words": [round(-1.0 - 0.1 * i, 4) for i in range(30)],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys are found more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    out = np.zeros(len(keys), bool)
    out[order] = same
    return out


def block_counts(block: Block) -> list[np.ndarray]:
    """The COUNTS of each row of a block."""
    data, offsets = block.data, block.offsets
    starts, _, words, first = block.words()
    n_words = np.diff(first)
    solid = np.zeros(len(data) + 1, np.int64)
    # characters of words: neither white space nor a later byte of a character
    inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    np.cumsum(inside, out=solid[1:])
    chars = sums_by_row(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = sums_by_row(_SYMBOLS[data], offsets)
    # lines: from a row's start or a line feed to the next, or to the row's end
    feeds = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.r_[offsets[:-1], feeds + 1])
    end = np.sort(np.r_[feeds, offsets[1:]])
    line_row = np.searchsorted(np.searchsorted(begin, offsets[:-1], "left"), np.arange(len(begin)), "right") - 1
    worded = solid[end] > solid[begin]
    begin, end, line_row = begin[worded], end[worded], line_row[worded]
    salt = row_of(np.arange(len(block) + 1)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    lines = span_hashes(byte_codes(data), begin, end) ^ salt[line_row]
    _, once = np.unique(lines, return_index=True)
    again = np.ones(len(lines), bool)
    again[once] = False
    n_lines = np.bincount(line_row, minlength=len(block))
    dup_lines = np.bincount(line_row[again], minlength=len(block))
    spot = within(first, 3)
    triples = window_hashes(words, 3)[spot] ^ salt[row_of(first)[spot]]
    cover = np.zeros(len(words) + 4, np.int64)
    hit = spot[_twice(triples)]
    cover[hit] += 1
    cover[hit + 3] -= 1
    repeated = sums_by_row(np.cumsum(cover)[: len(words)] > 0, first)
    return [n_words, chars, symbols, dup_lines, repeated, n_lines]


def measure(docs: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """docs' other columns, and with whole the text, with COUNTS of each whole text."""
    kept = [c for c in docs.columns if (whole or c != text) and c not in COUNTS]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in kept)).schema), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(len(kept))):
                counts = block_counts(block)
                yield pa.RecordBatch.from_arrays([*batch.slice(block.first, len(block)).columns[: len(kept)], *(pa.array(c, pa.int64()) for c in counts)], names=[*kept, *COUNTS])

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias("_measured")).mapInArrow(run, schema)


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """What the ladders are compared with; all rise as a text gets worse."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": per("n_symbols", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "long_words": per("word_chars", "n_words"),
        "short_words": -per("word_chars", "n_words"),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """The chance of k or fewer successes in n trials of chance p, summed exactly."""
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", allowed: float = FALSE_REJECTIONS, risk: float = RISK, joint: bool = False) -> DataFrame:
    """Per stratum one column a rule: the strictest certified cutoff, or null where none is."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = measured.where(~base_failed()).join(good, "doc_id", "left_semi").select(F.col(stratum).alias("stratum"), *(v.alias(k) for k, v in ratios().items()))
    # a good document counts against every step that would reject it: one count per step, summed before any shuffle
    steps = [F.sum(F.when(F.col(rule) > cut, 1).otherwise(0)).alias(f"{rule}_{i}") for rule, ladder in LADDERS.items() for i, cut in enumerate(ladder)]
    together = zip(*LADDERS.values(), strict=True)
    either = [reduce(Column.__or__, (F.col(rule) > cut for rule, cut in zip(LADDERS, cuts, strict=True))) for cuts in together]
    steps = [F.count_if(hit).alias(f"joint_{i}") for i, hit in enumerate(either)] if joint else steps
    counted = materialize(held.groupBy("stratum").agg(F.count("*").alias("n"), *steps))
    climbs = 1 if joint else len(LADDERS)
    share, level = allowed / climbs, risk / (max(1, counted.count()) * climbs)

    def climb(group: pd.DataFrame) -> pd.DataFrame:
        row, out = group.iloc[0], {}
        for rule, ladder in LADDERS.items():
            best = None
            for i, cut in enumerate(ladder):
                if binomial_tail(int(row[f"{'joint' if joint else rule}_{i}"]), int(row["n"]), share) > level:
                    break
                best = cut
            out[rule] = [best]
        return pd.DataFrame({"stratum": [row["stratum"]], **out})

    return counted.groupBy("stratum").applyInPandas(climb, "stratum string, " + ", ".join(f"{r} double" for r in LADDERS))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", joint: bool = False) -> DataFrame:
    """doc_id, COUNTS, base_failed, the ratios' verdict in `kept` and the failed rules in `failed`, for every row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias(stratum), F.col("text"))
    measured = materialize(measure(plain))
    return _verdicts(measured, cutoffs(measured, labels, stratum, joint=joint), stratum).select("doc_id", *COUNTS, "base_failed", "failed", "kept")


def _verdicts(measured: DataFrame, certified: DataFrame, stratum: str) -> DataFrame:
    limits = certified.select(F.col("stratum").alias("_stratum"), *(F.col(r).alias(f"most_{r}") for r in LADDERS))
    own = ratios()
    failed = F.array_compact(F.array(*(F.when(own[r] > F.col(f"most_{r}"), F.lit(r)) for r in LADDERS)))
    joined = measured.join(limits, measured[stratum].cast("string").eqNullSafe(limits["_stratum"]), "left")
    return joined.withColumns({"base_failed": base_failed(), "failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", joint: bool = False) -> DataFrame:
    """The rows of docs, whole, that no rule rejects; the cutoffs are certified on docs themselves."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias(stratum), F.col("text"))
    certified = materialize(cutoffs(materialize(measure(plain)), labels, stratum, joint=joint))
    own, names = aside(docs, "doc_id", "text", stratum)
    return _verdicts(measure(own, whole=True), certified, stratum).where("kept").select(*(F.col(n).alias(c) for c, n in names.items()))
