"""Every registered query with SQL equals it on the smallest tables; the others return rows."""

import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns, names):
    at = [names.index(c) for c in columns]
    text = lambda v: "null" if v is None else f"{v:.8g}" if isinstance(v, float) and v else "0" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    rows, sql = df.collect(), catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = oracle.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(rows, sorted(names), df.columns) == canonical(result.fetchall(), sorted(names), names)
