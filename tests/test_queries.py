import glob
import math
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as driver

ORACLE = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    rel = duck.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
