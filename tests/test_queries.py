"""A sample of the registered queries against their SQL at the smallest size; the driver compares all of them."""

import os

import duckdb
import pandas as pd
import pytest

from skein import queries

SF = "/root/testdata/sf0.001"


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
            return ""
        return f"{v:.6f}" if not isinstance(v, (str, bool)) and isinstance(float(v), float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", ["flagship", "undirected", "optional_some", "flow_limited", "producer_consumer_links", "host_links", "edge_dedup", "extract_tokens", "trace_stubs", "coverage"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    assert _rows(queries.queries()[name](spark, SF).toPandas()) == _rows(con.sql(queries.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())
