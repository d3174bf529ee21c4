"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from flowlens.plans.all_queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype) in ("object", "datetime64[us]", "datetime64[ns]") and len(df) and hasattr(df[c].iloc[0], "year"):
            df = df.assign(**{c: df[c].map(lambda v: str(v)[:19].removesuffix(" 00:00:00"))})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = plain(QUERIES[name](spark, DATA).toPandas()), plain(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all() and got[c].dtype.kind == "f":
            same |= (got[c] - want[c]).abs() <= 2e-6 * (1 + want[c].abs())
        assert same.all(), (c, got[~same].head(), want[~same].head())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
