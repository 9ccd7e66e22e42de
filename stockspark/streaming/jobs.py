"""Structured Streaming jobs.

T1 ``stream_ingest``: a file stream over a folder of raw exports; every new
   file is taken exactly once (the checkpoint records processed files) and
   mapped with the batch ingest inside ``foreachBatch``. Files that cannot be
   mapped are named with the reason in a side table.
T2 the same batch appends the snapshot entries of its imports and one log row
   an import, with floor arrivals against the stored rooms of the store's
   import before. Every target is partitioned by import and written with
   dynamic partition overwrite, so a replayed batch replaces its own rows
   instead of adding a second copy. An import that arrives late also renews
   the arrivals in the log row of the import after it.
T3 ``stream_summaries`` reduces new snapshot entries to mergeable summaries, and
   ``stream_velocity`` folds those into running state per barcode
   (``transformWithState`` on RocksDB): entries, first qty, last room
   and qty, room changes, trailing unchanged run. A hot barcode reaches the
   state as a few summaries a batch, each of at most ``SEGMENT_ROWS`` entries.
   Event-time timers remove barcodes not seen for ``expire_days``. Entries that
   are not newer than what their group already has are late: they go to a
   side table, and ``running_state`` recomputes the barcodes they touch, and
   only those, from the stored history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from stockspark.operators import history as hs
from stockspark.operators.velocity import barcode_history, snapshot_build, snapshot_summaries
from stockspark.session import scratch_dropped, writing, written_once
from stockspark.sources.ingest import ingest_files


def _stored(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A Parquet table, empty as long as nothing has been written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# Partitions a task writes side by side; a task that meets more sorts its remaining rows. Rows come file by file, so
# most tasks meet few where imports are large
OPEN_WRITERS = {"spark.sql.maxConcurrentOutputFileWriters": "4"}


def _replace(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` so that partitions it has replace those of an earlier run."""
    with writing(df.sparkSession, OPEN_WRITERS):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


# Files of about so many bytes are one micro-batch where files are imports: a batch's scratch tables stay as small
BATCH_BYTES = 2 << 30


def raw_line_stream(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """T1 source: lines of new files under ``path`` with file and offset."""
    r = spark.readStream.format("text").option("recursiveFileLookup", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    elif max_bytes:
        r = r.option("maxBytesPerTrigger", max_bytes)
    return r.load(path).select("value", F.col("_metadata.file_path").alias("file"),
                               F.col("_metadata.file_block_start").alias("_block"),
                               F.col("_metadata.file_modification_time").alias("_modified"))


def file_import(file: Column, modified: Column) -> dict[str, Column]:
    """What identifies a file's import if nothing else does: its path, and when it was written."""
    return {"import_id": F.sha1(file.cast("binary")), "import_ts": modified}


# stored as partitioned tables: the partition column comes last
LOG_SCHEMA = ("timestamp timestamp, store string, file_name string, "
              + ", ".join(f"{c} long" for c in hs.SUMMARY) + ", diag map<string,bigint>, floor_move_ups long, import_id string")
ENTRY_SCHEMA = ("store string, import_ts timestamp, entry_idx long, complete boolean, barcode string, room string, "
                "qty int, received_date date, import_id string")


def log_imports(rows: DataFrame, snapshots: str, log: str, candidate_rooms: Sequence[str], aliases: dict | None = None,
                floor_rooms: Sequence[str] = hs.FLOOR_SET) -> None:
    """Log rows of the imports in ``rows`` (inventory with ``store, import_id, import_ts, _ord``).

    Their snapshot entries are already in ``snapshots``. Floor arrivals compare an import with the stored rooms of the
    store's import before it; the row of an import that follows one of ``rows`` is written again. Only the
    partitions of these imports and of those before them are read.
    """
    spark = rows.sparkSession
    key = ["store", "import_id"]
    new = written_once(hs.import_log(rows, candidate_rooms, F.col("_ord"), aliases, floor_rooms, arrivals=False), "log-new")
    old = _stored(spark, log, LOG_SCHEMA).join(new.select("import_id"), "import_id", "left_anti")
    known = new.select(*key, "timestamp", F.lit(True).alias("is_new")).unionByName(
        old.select(*key, "timestamp", F.lit(False).alias("is_new")))
    before = Window.partitionBy("store").orderBy("timestamp", "import_id")         # one row an import
    pairs = known.select("*", F.lag("import_id").over(before).alias("previous"),
                         F.lag("is_new").over(before).alias("after_new"))
    pairs = written_once(pairs.where("is_new or after_new").select(*key, "previous"), "log-pairs")
    wanted = pairs.select("import_id").union(pairs.select("previous")).where("import_id is not null").distinct()
    entries = _stored(spark, snapshots, ENTRY_SCHEMA).where("complete").join(wanted, "import_id", "left_semi")
    rooms = hs.last_rooms(entries, key, aliases)
    then = rooms.select("store", F.col("import_id").alias("previous"), "barcode", F.col("room").alias("prev_room"))
    met = rooms.join(pairs, key).join(then, ["store", "previous", "barcode"]).where(
        hs.arrived("prev_room", "room", floor_rooms))
    counts = met.groupBy(*key).agg(F.count(F.lit(1)).alias("_arrived"))
    # an import's rows share a partition: those of other stores in it are written again too
    again = old.join(pairs.select("import_id"), "import_id", "left_semi").join(counts, key, "left").join(
        pairs.select(*key, F.lit(True).alias("_touched")), key, "left").withColumn(
        "floor_move_ups", F.when(F.col("_touched"), F.coalesce("_arrived", F.lit(0).cast("long"))).otherwise(
            F.col("floor_move_ups")))
    out = new.join(counts, key, "left").withColumn("floor_move_ups", F.coalesce("_arrived", F.lit(0).cast("long")))
    # written apart first: the log is read while its partitions are worked out
    _replace(written_once(out.select(*new.columns).unionByName(again.select(*new.columns)), "log-out"), log, "import_id")


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str,
                  available_now: bool = True, snapshots_target: str | None = None,
                  processing_time: str = "5 seconds", log_target: str | None = None,
                  rejected_target: str | None = None, candidate_rooms: Sequence[str] = (),
                  aliases: dict | None = None, max_files: int | None = None,
                  identify: Callable[[Column, Column], dict[str, Column]] = file_import,
                  max_bytes: int | None = None):
    """T1 (+T2 when the other targets are given): ingest every new export.

    ``identify(file, modified)`` gives ``import_id`` and ``import_ts`` of a file, and
    ``store`` if the files do not name one per row. A file that cannot be mapped does not stop the stream:
    it is left out and named with the reason in ``rejected_target`` (by default beside ``target``).
    ``max_files`` or ``max_bytes`` bound a micro-batch, ``BATCH_BYTES`` if neither is given and every file is an
    import of its own; files that ``identify`` takes for one import must come in one batch.
    """
    rejected_target = rejected_target or target.rstrip("/") + "_rejected"
    if max_bytes is None and identify is file_import:
        max_bytes = BATCH_BYTES

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_dropped(spark):               # the batch is in its targets then
            ingest_batch(batch, batch_id)

    def ingest_batch(batch: DataFrame, batch_id: int) -> None:
        found = ingest_files(batch, identify=identify)
        _replace(found.rejected.withColumn("import_id", F.sha1(F.col("file").cast("binary"))), rejected_target, "import_id")
        mapped = written_once(found.rows.drop("received_text").withColumn("batch_id", F.lit(batch_id)), "stream-mapped")
        _replace(mapped.drop("_ord", "import_ts"), target, "import_id")
        if not snapshots_target:
            return
        mapped = mapped.withColumn("store", F.coalesce("store", F.lit("")))
        required = [F.col(c).isNotNull() for c in ("product_name", "brand", "package_barcode", "room")]
        entries = snapshot_build(
            mapped.withColumn("entry_idx", F.col("_ord")).withColumn("complete", reduce(Column.__and__, required)),
            keep=("store", "import_id", "import_ts", "entry_idx", "complete"))
        _replace(entries, snapshots_target, "import_id")
        if log_target:
            log_imports(mapped, snapshots_target, log_target, candidate_rooms, aliases)

    w = (raw_line_stream(spark, source, max_files, max_bytes).writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


# ------------------------------------------------------------------------ T3

EXPIRE_DAYS = 90
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRIES = "barcode string, snapshot_date date, entry_idx long, room string, qty int"
_STATE = ("n long, first_qty long, last_room string, last_qty long, changes long, run long, last_snapshot date")
_UPDATE = ("barcode string, n_entries long, room_changes long, first_qty long, last_qty long, "
           "qty_unchanged_streak long, last_snapshot date, expired boolean")


def stream_summaries(spark: SparkSession, source: str, target: str, late: str, checkpoint: str,
                     schema: str = ENTRIES, expire_days: int = EXPIRE_DAYS, max_files: int | None = None):
    """T3, first half: files of snapshot entries under ``source`` -> summaries under ``target``, late entries under ``late``.

    A snapshot is late if it is not newer than the newest one of an earlier batch. Both targets are
    partitioned by batch, so a replayed batch replaces its own rows.
    """
    table = snapshot_summaries(spark.createDataFrame([], schema)).schema

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        earlier = _stored(spark, target, StructType(table.fields).add("batch_id", "long")).where(F.col("batch_id") < batch_id)
        newest = earlier.agg(F.max("snapshot_date").alias("d")).first().d          # one value
        on_time = F.lit(True) if newest is None else F.coalesce(F.col("snapshot_date") > F.lit(newest), F.lit(False))
        number = F.lit(batch_id).cast("long")
        _replace(batch.where(~on_time).withColumn("batch_id", number), late, "batch_id")
        _replace(snapshot_summaries(batch.where(on_time)).withColumn("batch_id", number), target, "batch_id")

    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return (r.parquet(source).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class RunningVelocity(StatefulProcessor):
    """State of one barcode; its summaries are folded in order, a timer removes it when it is no longer seen."""

    def __init__(self, expire_days: int):
        self.expire_days = expire_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("velocity", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        n, first_qty, last_room, last_qty, changes, run, last = held or (0, None, None, None, 0, 0, None)
        before = last
        # one row a snapshot and SEGMENT_ROWS entries
        for s in sorted(rows, key=lambda r: (r["seg"] is None, r["seg"])):
            if n == 0:
                first_qty = int(s["first_qty_s"])
            changes += s["changes_s"] + int(n > 0 and s["first_room_s"] != last_room)
            unbroken = s["tail_s"] == s["n_s"] and n > 0 and int(s["last_qty_s"]) == last_qty
            run = s["tail_s"] + (run if unbroken else 0)
            n += s["n_s"]
            last_room, last_qty, last = s["last_room_s"], int(s["last_qty_s"]), s["snapshot_date"]
        # a timer that is there stays: it looks at the newest day when it goes off
        if before is not None and last < before:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
        if before is None or last < before:
            self.handle.registerTimer(self._expires(last))
        self.state.update((n, first_qty, last_room, last_qty, changes, run, last))
        yield self._row(key, (n, first_qty, last_room, last_qty, changes, run, last), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        got = self.state.get()
        due = self._expires(got[-1])
        if due >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)          # seen again since the timer was set
            return
        self.state.clear()
        yield self._row(key, got, True)

    def _expires(self, last: dt.date) -> int:
        """Milliseconds of the end of a barcode's last day, ``expire_days`` on."""
        day = dt.datetime(last.year, last.month, last.day, tzinfo=dt.timezone.utc) + dt.timedelta(days=self.expire_days)
        return int(day.timestamp() * 1000)

    @staticmethod
    def _row(key, got: tuple, expired: bool) -> Row:
        n, first_qty, _, last_qty, changes, run, last = got
        return Row(barcode=key[0], n_entries=n, room_changes=changes, first_qty=first_qty, last_qty=last_qty,
                   qty_unchanged_streak=run - 1 if n >= 2 else 0, last_snapshot=last, expired=expired)

    def close(self) -> None:
        pass


def running_velocity(summaries: DataFrame, expire_days: int = EXPIRE_DAYS) -> DataFrame:
    """State per barcode over a stream of summaries; one row per barcode touched or expired in a micro-batch."""
    timed = (summaries.withColumn("at", F.col("snapshot_date").cast("timestamp")).withWatermark("at", "0 seconds")
                      .withColumnRenamed("_seg", "seg"))       # the state API renames columns with an underscore in front
    return timed.groupBy("barcode").transformWithState(
        RunningVelocity(expire_days), _UPDATE, "Update", "EventTime")


def stream_velocity(spark: SparkSession, source: str, target: str, checkpoint: str, expire_days: int = EXPIRE_DAYS):
    """T3, second half: summaries under ``source`` (written by ``stream_summaries``) -> updates under ``target``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        _replace(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), target, "batch_id")

    schema = snapshot_summaries(spark.createDataFrame([], ENTRIES)).schema
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, ROCKSDB)          # read when a query starts
    try:
        s = spark.readStream.schema(schema).parquet(source)
        return (running_velocity(s, expire_days).writeStream.outputMode("update").foreachBatch(sink)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(conf)
        else:
            spark.conf.set(conf, before)


def latest_state(updates: DataFrame) -> DataFrame:
    """Newest emitted row per barcode, without expired ones."""
    cols = [c for c in updates.columns if c not in ("barcode", "batch_id")]
    newest = F.struct("batch_id", "last_snapshot", F.col("expired").cast("int").alias("_e"))
    agg = updates.groupBy("barcode").agg(F.max_by(F.struct(*cols), newest).alias("s"))
    return agg.select("barcode", "s.*").where("not expired")


def running_state(updates: DataFrame, late: DataFrame, history: DataFrame) -> DataFrame:
    """Running state with late entries folded in: barcodes that ``late`` touches are recomputed from ``history``
    (all stored entries, late ones included), every other barcode keeps its streamed state."""
    touched = late.select("barcode").distinct()
    streamed = latest_state(updates).drop("expired")
    again = barcode_history(history.join(touched, "barcode", "left_semi")).select(
        "barcode", "n_entries", "room_changes", F.col("first_qty").cast("long").alias("first_qty"),
        F.col("last_qty").cast("long").alias("last_qty"), "qty_unchanged_streak",
        F.col("last_snapshot").alias("last_snapshot"))
    return streamed.join(touched, "barcode", "left_anti").unionByName(again)
