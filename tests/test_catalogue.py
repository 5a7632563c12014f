"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from quillon.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    return value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in result.collect()), key=repr) == want
