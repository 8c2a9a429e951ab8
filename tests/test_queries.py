"""Every registered query against its SQL, on whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from ticktape.plans import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_queries_and_sql_name_the_same():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, database, name):
    df = registry.queries()[name](spark, sf_dir)
    cursor = database.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert _normal([tuple(r) for r in df.collect()], df.columns) == _normal(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
