"""Every query against its SQL oracle (DuckDB) on the smallest scale factor:
the driver's correctness gate, run locally."""

import decimal
import math

import duckdb
import pytest

from helpers import SF0001
from __spark_entry__ import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KEYS = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_every_key_has_an_oracle():
    assert set(oracle_sql()) == set(KEYS)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = queries()[key](spark, SF0001)
    got = df.collect()
    res = con.execute(oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, got) == _rows(ocols, res.fetchall())
