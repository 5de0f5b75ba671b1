"""Every registered query with an oracle gives DuckDB's rows."""

import math

import duckdb
import pytest

from sparkloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall())
    assert sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_every_query_has_rows_or_an_oracle(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).limit(1).count() == 1
