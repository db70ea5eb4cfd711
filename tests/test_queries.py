"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from eventloom import named as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(str, map(plain, r))) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_same_as_sql(spark, duck, name):
    assert rows(__spark_entry__.queries()[name](spark, SF).toPandas()) == rows(duck.execute(engine.ORACLES[name]).fetchdf())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
