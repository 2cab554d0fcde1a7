"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from weftline.plans import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def cells(df: pd.DataFrame) -> list:
    def one(x):
        if isinstance(x, float):
            return "null" if x != x else f"{x:.9g}"
        if x is None or x is pd.NaT or x is pd.NA:
            return "null"
        return str(pd.Series(list(x)).tolist()) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)

    def column(c):
        return [("null" if pd.isna(x) else f"{float(x):.9g}") for x in df[c]] if pd.api.types.is_float_dtype(df[c]) else [one(x) for x in df[c]]

    return sorted(zip(*[column(c) for c in sorted(df.columns)], strict=True))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
