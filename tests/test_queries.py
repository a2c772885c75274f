"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from engrama.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return round(float(value), 5)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    relation = sql.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(relation.columns)
    order = [list(relation.columns).index(c) for c in got.columns]
    expected = sorted([tuple(plain(r[i]) for i in order) for r in relation.fetchall()], key=str)
    assert sorted([tuple(map(plain, r)) for r in got.collect()], key=str) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
