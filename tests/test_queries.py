"""Every core query runs, and gives what its SQL gives."""

import datetime
import decimal
import math

import pytest

import __spark_entry__ as entry
from lakeweave import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return str(v) if isinstance(v, datetime.datetime) else v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, small, db, name):
    df = queries.QUERIES[name](spark, small)
    got = df.collect()
    spark.catalog.clearCache()
    want = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["n_name", "n_orders", "revenue"] and df.count() > 0


def test_steiner_query_spans_its_terminals(spark, small):
    got = queries.QUERIES["steiner_tree"](spark, small).collect()
    tables = {t for r in got for t in (r.table1, r.table2)}
    assert {"region", "lineitem", "part"} <= tables and len(got) == len(tables) - 1


def test_names_agree():
    every = entry.queries()
    assert set(entry.oracle_sql()) <= set(every)
    if "pipeline" in every:  # the corpus operators may have been taken out
        assert sum(n.startswith("op") and n[2].isdigit() for n in every) == 10
