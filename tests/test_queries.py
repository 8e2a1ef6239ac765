"""Every query of the library against its SQL at the smallest size."""

import os

import duckdb
import pytest

from quarry.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return connection


def compared(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(fixed(r[i]) for i in order) for r in rows), key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, FOLDER)
    got = compared(found.columns, [tuple(r) for r in found.collect()])
    if name in ORACLES:
        expected = sql.sql(ORACLES[name])
        assert got == compared(expected.columns, expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
