"""Folding and counting the words of lines: right on odd white space, and no text rewritten for nothing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import line_dedup


def texts() -> list[str | None]:
    deal = random.Random(5)
    odd = ["".join(deal.choice(["a", "B", "É", "中", " ", " ", "  ", "\t", "\r", "\f", "\x0b", "\n"]) for _ in range(deal.randint(0, 18))) for _ in range(400)]
    return [None, "", " ", "\t", "\n \n", "A\tB", "a  b", " a b ", "\ta\r\nb\x0b", *odd]


def test_folding_and_least_words_against_plain_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    has = [line_dedup._has_words(F.col("t"), k).alias(f"w{k}") for k in range(5)]
    for r in rows.select("t", line_dedup.folded(F.col("t")).alias("folded"), *has).collect():
        if r.t is None:
            assert r.folded is None
            continue
        assert r.folded == re.sub(" {2,}", " ", re.sub("[\t\x0b\f\r]", " ", r.t.lower()))
        # an empty line is left out by itself
        assert not r.t or [r[f"w{k}"] for k in range(5)] == [r.t.count(" ") + 1 >= k for k in range(5)]


@pytest.mark.parametrize("fold", [True, False])
def test_no_line_is_rewritten_to_count_its_words_in_a_filter(spark, fold):
    docs = spark.createDataFrame([(1, "one two three\nfour")], "doc_id long, text string")
    plan = line_dedup.lines(docs, 3, fold)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert filters and not any("replace(" in x for x in filters)
