"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


INITIAL_PARTITIONS = 8192       # shuffle partitions before AQE merges them, on a cluster


def get_session(master: str | None = None, app: str = "stockspark",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    * AQE on: coalesces small shuffle partitions, splits skewed join
      partitions (a hot barcode / product), turns joins into broadcast joins
      only when the runtime size of a side is below the threshold.
    * session time zone UTC so dates and timestamps compare with the oracle.
    * UI off: no web server is started.
    * ``codegen.hugeMethodLimit`` = 8000: a whole-stage method larger than
      the JIT's huge-method limit would run interpreted; Spark then falls
      back to per-operator code for that stage only.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        return running                     # a user's own settings stay as they are
    b = SparkSession.builder.appName(app)
    local = (master or os.environ.get("MASTER", "")).startswith("local")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif not local:
        # AQE only merges partitions, so a large job starts with many
        b = b.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(INITIAL_PARTITIONS))
    if local or "SPARK_DRIVER_MEMORY" in os.environ:
        b = b.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.codegen.hugeMethodLimit", "8000")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is the folder named by ``spark.checkpoint.dir`` (a
    shared file system); without one the call fails. Only a local-mode
    session without the setting (tests) gets a fresh local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS / object "
                               "storage); a machine-local folder is not usable on a cluster")
        d = tempfile.mkdtemp(prefix="stockspark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    import uuid
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    for made in getattr(_scratch, "made", []):
        made.append(path)
    return path


_scratch = threading.local()       # per block of ``scratch_dropped`` of this thread, the folders named in it


@contextmanager
def scratch_dropped(spark: SparkSession) -> Iterator[None]:
    """Scratch folders named in the block are deleted at its end; nothing that reads them may be used after it."""
    made: list[str] = []
    _scratch.made = [*getattr(_scratch, "made", []), made]
    try:
        yield
    finally:
        _scratch.made = _scratch.made[:-1]
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# While a table is written: its shuffles leave the disk as soon as it is there (else they stay until the driver
# collects garbage), and oversized methods are not run un-JITted (see get_session)
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def writing(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """``WRITING`` and ``more`` settings for the block; then the session's settings are as before."""
    wanted = WRITING | (more or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in a scratch folder."""
    path = scratch_path(df.sparkSession, name)
    with writing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
