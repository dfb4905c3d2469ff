"""Every registered query against its DuckDB twin at sf0.001 (rows-only ones must run)."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES = E.queries()
SQLS = E.oracle_sql()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    pdf = QUERIES[name](spark, SF).toPandas()
    if name not in SQLS:
        assert len(pdf.columns) > 0
        return
    c1, r1 = _rows(pdf)
    c2, r2 = _rows(duck.execute(SQLS[name]).df())
    assert c1 == c2
    assert r1 == r2


def test_entry(spark):
    out = E.entry(spark)
    assert out.count() > 0 and out.columns == ["reason", "n"]
