"""Engine queries against DuckDB on the small test tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tesserae.plans.all_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(x):
        if isinstance(x, (list, np.ndarray)):
            return str(list(x))
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and np.isnan(x):
            return "null"
        return repr(float(x)) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
