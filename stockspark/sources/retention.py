"""Retention on stored snapshots (T4): expired days are dropped, small files merged.

The history is Parquet partitioned by day and import. Dropping a day removes its
folders, whatever their size. Merging writes the small files of a partition anew
beside the table, then swaps the folders one by one; what a run leaves behind
when it is stopped is finished or thrown away by the next one, so both can be
repeated at any time. Only folder names and file sizes reach the driver. Readers
see a partition as it was or as it is, but for the moment between two renames.

Defined cases: a day equal to the cutoff stays; ``days`` of 0 or less drops nothing;
folders that are not days are left alone; a missing table is an empty one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "snapshot_date"
TARGET_BYTES = 128 << 20        # of a merged file
SMALL_FILES = 2                 # files of a partition that are worth merging
_WORK = "_merging"              # readers skip names that start with an underscore
_OLD = "_replaced"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at(path)) if s.isDirectory())


def _day(folder: str) -> dt.date | None:
    name, _, value = folder.partition("=")
    try:
        return dt.date.fromisoformat(value) if name == DAY else None
    except ValueError:
        return None


def expired_days(spark: SparkSession, path: str, days: int, as_of: dt.date) -> list[dt.date]:
    """Stored days older than ``as_of - days``."""
    if not days or days <= 0:
        return []
    cutoff = as_of - dt.timedelta(days=int(days))
    return [d for d in map(_day, _folders(spark, path)) if d is not None and d < cutoff]


def purge_store(spark: SparkSession, path: str, days: int, as_of: dt.date) -> list[dt.date]:
    """Drop the partitions of expired days; the days dropped. A repeated run finds nothing to do."""
    gone = expired_days(spark, path, days, as_of)
    fs, at = _fs(spark, path)
    for d in gone:
        fs.delete(at(f"{path}/{DAY}={d.isoformat()}"), True)
    return gone


def purge_store_all(spark: SparkSession, path: str) -> int:
    """Drop every stored day."""
    fs, at = _fs(spark, path)
    found = [f for f in _folders(spark, path) if _day(f) is not None]
    for f in found:
        fs.delete(at(f"{path}/{f}"), True)
    return len(found)


def _partitions(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """``day/import`` folder -> (data files, bytes)."""
    fs, at = _fs(spark, path)
    out = {}
    for day in _folders(spark, path):
        if _day(day) is None:
            continue
        for part in _folders(spark, f"{path}/{day}"):
            files = [s for s in fs.listStatus(at(f"{path}/{day}/{part}")) if s.getPath().getName().endswith(".parquet")]
            out[f"{day}/{part}"] = (len(files), sum(s.getLen() for s in files))
    return out


def _finish(spark: SparkSession, path: str) -> None:
    """Bring a stopped merge to an end: a replaced folder whose partition is missing goes back or is completed."""
    fs, at = _fs(spark, path)
    for day in _folders(spark, f"{path}/{_OLD}"):
        for part in _folders(spark, f"{path}/{_OLD}/{day}"):
            old, now = at(f"{path}/{_OLD}/{day}/{part}"), at(f"{path}/{day}/{part}")
            if not fs.exists(now):
                fs.mkdirs(now.getParent())
                fs.rename(old, now)
    for name in (_OLD, _WORK):
        if fs.exists(at(f"{path}/{name}")):
            fs.delete(at(f"{path}/{name}"), True)


def merge_store(spark: SparkSession, path: str, small_files: int = SMALL_FILES, target_bytes: int = TARGET_BYTES) -> int:
    """Merge the files of partitions that have ``small_files`` or more and need fewer; the partitions merged."""
    _finish(spark, path)
    todo = {p: -(-size // target_bytes) or 1 for p, (n, size) in _partitions(spark, path).items()
            if n >= small_files and n > (-(-size // target_bytes) or 1)}
    if not todo:
        return 0
    table = spark.read.parquet(path)
    names = [p.split("=")[0] for p in next(iter(todo)).split("/")]
    # one row a partition to be merged: how many files it gets; large ones are dealt over as many tasks
    wanted = spark.createDataFrame([(p, int(n)) for p, n in sorted(todo.items())], "_p string, _files long")
    where = F.concat_ws("/", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])
    rows: DataFrame = table.withColumn("_p", where).join(F.broadcast(wanted) if len(todo) <= 100_000 else wanted, "_p")
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64(*[c for c in table.columns if c not in names]), F.col("_files")))
    tasks = min(sum(todo.values()), max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    (rows.repartition(tasks, "_p", "_deal").drop("_p", "_files", "_deal")
         .write.mode("overwrite").partitionBy(*names).parquet(f"{path}/{_WORK}"))
    fs, at = _fs(spark, path)
    for p in sorted(todo):
        fs.mkdirs(at(f"{path}/{_OLD}/{p}").getParent())
        fs.rename(at(f"{path}/{p}"), at(f"{path}/{_OLD}/{p}"))
        fs.rename(at(f"{path}/{_WORK}/{p}"), at(f"{path}/{p}"))
    for name in (_OLD, _WORK):
        fs.delete(at(f"{path}/{name}"), True)
    return len(todo)
