"""Every query whose SQL is given returns what the SQL does, over small tables."""

import datetime

import duckdb
import pytest

import __spark_entry__
from showloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def rows(found):
    return sorted(tuple(repr(v if not isinstance(v, datetime.datetime) else v.isoformat()) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert rows(map(tuple, got.select([f"`{c}`" for c in columns]).collect())) == rows(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
