"""Every query with SQL gives what the SQL gives on the same tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from compare import rows

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    got = pd.DataFrame(df.collect(), columns=df.columns)
    want = duck.execute(entry.oracle_sql()[name]).df()
    columns, mine = rows(got)
    names, theirs = rows(want)
    assert columns == names
    assert mine == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 2


def test_sql_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
