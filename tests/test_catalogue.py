"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from feedback_engine.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple("~" if pd.isna(x) else repr(x.item() if hasattr(x, "item") else x) for x in r) for r in df.itertuples(index=False, name=None)))


def close(a: str, b: str) -> bool:
    if a == b:
        return True
    try:
        return float(a) == float(b)
    except ValueError:
        return False


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(close, x, y))]
    assert not bad, bad[:3]
