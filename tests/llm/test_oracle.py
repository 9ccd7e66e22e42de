"""Queries that SQL can express equal their DuckDB SQL; all are registered."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

from ..conftest import SF0001


def test_all_are_registered():
    names = set(queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("key", ["op1_warc_fixity", "op4_ball_tree_top_k", "op9_source_mixing",
                                 "op12_hard_negatives"])
def test_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    df = queries()[key](spark, SF0001)
    res = con.execute(oracle_sql()[key])
    names = [d[0] for d in res.description]
    want = sorted((tuple(r) for r in res.fetchall()), key=str)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert len(got) == len(want) and got == want
