"""Every query with SQL gives the rows of its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from folioform.plans.catalog import QUERIES, SQL


def _rows(columns, rows):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, float):
            return round(v, 9)
        return v

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    res = duck.execute(SQL[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_module(spark):
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
