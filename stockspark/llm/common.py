"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.session import scratch_path

# Rows per Arrow batch handed to Python. Texts can be long, so a batch is kept
# small; inside a batch texts are cut into slices of bounded bytes (flat.py).
BATCH_ROWS = 512
# A side of a few ids a row may be broadcast up to this many rows (under 32 MB);
# beyond it the same join runs as a shuffle join.
BROADCAST_IDS = 500_000
# Rows of a few numbers that one file of an intermediate table holds.
ROWS_A_FILE = 50_000


def small_batches(spark: SparkSession) -> None:
    """Limit the rows of the Arrow batches that Python gets."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, with Arrow batches limited in rows."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the files, not a
    recomputation of everything before them. ``rows``: a bound on the rows of a
    narrow result; it is then written as one partition for every ``ROWS_A_FILE``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_side(ids: DataFrame) -> DataFrame:
    """A table of ids, broadcast only if its counted size is within the bound."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def learned(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
