"""Every query against its SQL twin on the smallest tables; queries without one must give rows."""

import duckdb
import pytest

from plinth.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind == "f":
            df[k] = df[k].round(6) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    found = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLES:
        assert len(found) > 0
        return
    expected = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    a, b = plain(found), plain(expected)
    assert a.shape == b.shape and (a.values == b.values).all()


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
