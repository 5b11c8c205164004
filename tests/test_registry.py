"""Every registered query against its SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from fleetline.plans import oracle, registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, CHECKS = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def as_rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=str)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert as_rows(df.columns, df.collect()) == as_rows(names, cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(contract.queries()) and set(CHECKS) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() >= 0
