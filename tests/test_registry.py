"""Every query with SQL gives what the SQL gives, on the smallest data."""

import datetime as dt
import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    df = entry.queries()[name](spark, DATA)
    want = oracle.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert bag(map(tuple, df.collect()), df.columns) == bag(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_written_tables_can_be_forgotten(spark):
    import os

    from tallyweir.session import forget, written

    t = written(spark.range(1000).repartition(7, "id").groupBy("id").count(), "forgotten")
    assert t.count() == 1000
    path = t._written_at.removeprefix("file://")
    assert os.path.isdir(path)
    forget(t)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tallyweir.session import shared_dir

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with __import__("pytest").raises(ValueError):
        shared_dir(bare)
