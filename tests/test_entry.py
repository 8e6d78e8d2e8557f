"""Every query beside its SQL on the smallest tables, as the driver does it on larger ones."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([f"{v:.6f}" if isinstance(v, float) else str(v) for v in (r[k] for k in order)]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.base.QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        got = duck.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(df.columns) == sorted(names)
        assert norm(rows, df.columns) == norm(got.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "c_custkey"
