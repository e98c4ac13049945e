"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from rostra.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(rows, columns, names):
    at = [names.index(c) for c in columns]
    return sorted([tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in at) for r in rows])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    rel = db.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], columns, df.columns) == plain(rel.fetchall(), columns, rel.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
