"""Every catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from rillcep import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAME = [n for n in catalogue.QUERIES if n in catalogue.ORACLES]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SAME)
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = db.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = ordered(found.fetchall())
    assert ordered(tuple(r) for r in df.select(columns).collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0
