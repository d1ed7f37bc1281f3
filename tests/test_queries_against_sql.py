"""Every named query against its SQL twin in a second engine."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES = entry_points.queries()
TWINS = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def _order(row):
    return tuple((v is None, str(type(v)), v) for v in row)


def test_all_have_a_twin():
    from stowage.plans import oracles, queries

    assert set(queries.queries()) == set(oracles.oracle_sql())
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=_order)
    cursor = duck.execute(TWINS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(row[i] for i in at) for row in cursor.fetchall()), key=_order)
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_entry_is_one_row(spark):
    row = entry_points.entry(spark).collect()
    assert len(row) == 1 and row[0]["file_count"] == 6000
