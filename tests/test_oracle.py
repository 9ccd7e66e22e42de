"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import math

import duckdb
import pytest

from __spark_entry__ import entry
from stockspark.plans import ORACLE, QUERIES

from .conftest import SF0001
from .test_plans import FORBIDDEN

TABLES = ["lineitem", "part", "supplier", "events", "orders"]
SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}
SLOW = {"ingest_raw", "stream_ingest", "stream_snapshots"}


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        return "<nan>" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if s.endswith("T00:00:00") else s.replace("T", " ")
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(k for k in ORACLE if k not in SLOW))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF0001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for pat in FORBIDDEN:
        assert pat not in plan, f"{key}: {pat}"
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    duck = {d[0]: str(d[1]) for d in res.description}
    for name, t in df.dtypes:
        if t in SPARK_TO_DUCK:
            assert SPARK_TO_DUCK[t] == duck[name], f"{key}.{name}: {t} vs {duck[name]}"
    assert _rows(df.columns, srows) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "package_barcode" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
