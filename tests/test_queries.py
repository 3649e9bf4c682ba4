"""Registered queries against their SQL texts, where the sample tables are at hand."""

import math
import os

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(__spark_entry__.oracle_sql())
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")


def plain(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "~"
        return f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    assert plain(__spark_entry__.queries()[name](spark, FOLDER).toPandas()) == plain(db.sql(__spark_entry__.oracle_sql()[name]).df())


def test_every_query_has_a_result(spark):
    names = [n for n in __spark_entry__.queries() if n not in __spark_entry__.oracle_sql() and not n.startswith("op") and n != "pipeline"]
    for n in names:
        __spark_entry__.queries()[n](spark, FOLDER).write.format("noop").mode("overwrite").save()
    assert __spark_entry__.entry(spark).count() > 0
