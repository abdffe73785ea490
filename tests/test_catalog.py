"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

from folioscope.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 6) if isinstance(x, float) else str(x) if not isinstance(x, int | str) else x

    return sorted([tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)], key=repr)


def test_names():
    assert catalog.FLAGSHIP in catalog.QUERIES and set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, oracle, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), oracle.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)
