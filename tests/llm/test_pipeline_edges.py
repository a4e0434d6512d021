"""Each stage of the pipeline on odd rows: nulls, repeats, ties, no rows, and columns with clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "the item of a benchmark that nobody may train on")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def _prose(name, n=70):
    return " ".join(f"{name}{i}" for i in range(n))


ROWS = [
    (1, _prose("a"), "en", "s", 1), (1, _prose("a"), "en", "s", 1), (None, _prose("b"), None, None, None), (2, None, None, "s", None), (2, None, None, "s", None), (3, "", "en", None, 0),
    (4, _prose("c"), "en", "s", 5), (4, _prose("d"), "en", "s", 5), (5, _prose("e") + " x", "en", "s", 5), (6, _prose("e") + " y", "en", "s", 5), (7, "w " * 30_000, "en", "s", 5),
]


def _run(spark, sf, name, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"n_lines": F.lit("x"), "coverage": F.lit(1), "_row": F.lit("y"), "token_ids": F.lit("z"), "component_id": F.lit(None).cast("string")})
    return STAGES[name](spark, docs, sf)


def _found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:4], r.text is None) for r in df.collect())


def test_each_stage_defines_odd_rows(spark, sf):
    every = sorted((i if i is not None else -1, (t or "")[:4], t is None) for i, t, *_ in ROWS)
    kept = _run(spark, sf, "quality_rules", ROWS)
    assert kept.columns == corpus_pipeline.COLUMNS
    # short ones and the one that repeats itself go
    assert _found(kept) == [x for x in every if x[0] not in (2, 3, 7)]
    lines = _run(spark, sf, "deduplicated_lines", ROWS)
    assert lines.columns == corpus_pipeline.COLUMNS
    # of the two equal rows one line is left; near lines go too, and nothing else
    assert [x for x in _found(lines) if x[0] not in (1, 5, 6)] == [x for x in every if x[0] not in (1, 5, 6)]
    assert sum(x[0] == 1 and x[1] == "a0 a" for x in _found(lines)) == 1
    one = _run(spark, sf, "one_of_each_group", ROWS)
    assert one.columns == corpus_pipeline.COLUMNS and _found(one) == sorted([x for x in every if x[0] not in (1, 6)] + [(1, "a0 a", False)])
    clean = _run(spark, sf, "decontaminated", [*ROWS, (9, "so: The item, of a benchmark that nobody may train on!", "en", "s", 1)])
    assert clean.columns == corpus_pipeline.COLUMNS and _found(clean) == every
    coded = _run(spark, sf, "token_ids", ROWS).collect()
    assert len(coded) == len(ROWS) and {r.n_tokens for r in coded if r.doc_id in (2, 3)} == {0}


@pytest.mark.parametrize("name", list(STAGES))
def test_no_rows(spark, sf, name):
    assert _run(spark, sf, name, []).collect() == []
