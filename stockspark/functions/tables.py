"""Small literal tables built on the JVM (no Python RDD, no Python workers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A DataFrame of ``rows`` with the DDL schema ``"a int, b string"``.

    Meant for parameter-sized tables (bucket lists, saved selections);
    ``inline`` of a literal array keeps it in one JVM projection.
    """
    fields = [f.strip().split() for f in ddl.split(",")]
    names = [f[0] for f in fields]
    types = [f[1] for f in fields]
    struct_t = "array<struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, types)) + ">>"
    arr = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types)])
                    for r in rows]).cast(struct_t) if rows else F.array().cast(struct_t)
    return spark.range(1).select(F.inline(arr))
