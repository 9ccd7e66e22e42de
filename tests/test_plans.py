"""Plan shape guards. The no-cross-join / no-Python-UDF check runs inside
test_oracle for every batch query; here the flagship scan is checked for
column pruning."""

from __spark_entry__ import queries

from .conftest import SF0001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(spark, key):
    return queries()[key](spark, SF0001)._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_columns(spark):
    plan = _plan(spark, "move_up_merged")
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert scans
    for s in scans:
        for unused in ("l_tax", "l_returnflag", "l_linestatus"):
            assert unused not in s
