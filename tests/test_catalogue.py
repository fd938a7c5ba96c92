"""Every query with SQL gives the SQL's rows; the others give rows with a stable schema."""

import glob
import os

import pytest

import __spark_entry__
from conftest import DATA
from florilege import catalogue

pytest.importorskip("duckdb")


def rows(columns, table):
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([tidy(v) for v in r]) for r in zip(*(table[c].to_pylist() for c in columns), strict=True))


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, db, name):
    got = __spark_entry__.queries()[name](spark, DATA).toArrow()
    want = db.sql(catalogue.SQL[name]).to_arrow_table()
    columns = sorted(got.schema.names)
    assert columns == sorted(want.schema.names)
    assert rows(columns, got) == rows(columns, want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_gives_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
