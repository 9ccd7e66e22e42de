"""Snapshot history and import log storage (S5-S7) and report sinks.

The desktop tool keeps its history as one nested JSON document
``{version, snapshots: [{timestamp, file_name, entries: [...]}]}`` (or, in an
older form, a bare list of snapshots). Here the history lives as Parquet
partitioned by snapshot date and import: appends add partitions, retention and
diffs prune partitions, and a replayed import overwrites its own partition
(dynamic partition overwrite) instead of adding a second copy. The JSON forms are read
for import; writing JSON splits every snapshot into bounded chunks so no
record holds a whole import.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

ENTRY = T.StructType([
    T.StructField("entry_idx", T.LongType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("room", T.StringType()),
    T.StructField("qty", T.LongType()),
    T.StructField("received_date", T.StringType()),
])
SNAPSHOT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("entries", T.ArrayType(ENTRY)),
])
# one shape for both forms: a document with snapshots, or a snapshot by itself
DOCUMENT = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("snapshots", T.ArrayType(SNAPSHOT)),
    *SNAPSHOT.fields,
])
CHUNK = 1000


def read_snapshot_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Nested history -> flat entries ``(snapshot_idx, snapshot_ts,
    snapshot_date, file_name, entry_idx, barcode, room, qty, received_date)``.

    Accepts the dict form (``snapshots`` array), the bare-list form (one
    snapshot per element / line) and the chunked lines written below.
    ``snapshot_idx`` orders snapshots: the record's place in the file order, then the
    snapshot's position in it, however many a record holds; entries keep their own
    ``entry_idx`` when present, else their position in the record.
    """
    try:
        doc = spark.read.schema(DOCUMENT).option("multiLine", multiline).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        doc = spark.createDataFrame([], DOCUMENT)          # no history yet
    own = F.array(F.struct("timestamp", "file_name", "entries"))
    # a record's numbers start behind those of the longest record before it could have used
    longest = doc.select(F.coalesce(F.max(F.greatest(F.size("snapshots"), F.lit(1))), F.lit(1)).cast("long")).scalar()
    record = doc.select(F.monotonically_increasing_id().alias("_record"), F.coalesce("snapshots", own).alias("s"))
    snaps = record.select("_record", F.posexplode("s").alias("_pos", "s")).select(
        (F.col("_record") * longest + F.col("_pos")).alias("snapshot_idx"), "s.*")
    flat = snaps.select("snapshot_idx", "timestamp", "file_name",
                        F.posexplode("entries").alias("pos", "e"))
    ts = F.try_to_timestamp(F.col("timestamp"))
    return flat.select(
        "snapshot_idx", ts.alias("snapshot_ts"), F.to_date(ts).alias("snapshot_date"), "file_name",
        F.coalesce(F.col("e.entry_idx"), F.col("pos").cast("long")).alias("entry_idx"),
        F.col("e.barcode").alias("barcode"), F.col("e.room").alias("room"),
        F.col("e.qty").cast("int").alias("qty"), F.col("e.received_date").alias("received_date"))


def write_snapshot_json(entries: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write flat entries in the nested snapshot shape, one JSON line per
    chunk of at most ``chunk`` entries of one snapshot (never a whole import
    in one record)."""
    c = F.floor(F.col("entry_idx") / chunk)
    rec = (entries.groupBy("snapshot_date", c.alias("_chunk"))
           .agg(F.array_sort(F.collect_list(F.struct(
               "entry_idx", "barcode", "room", F.col("qty").cast("long").alias("qty"),
               F.lit("").alias("received_date")))).alias("entries")))
    rec.select(F.date_format(F.col("snapshot_date").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
               F.concat(F.lit("snapshot_"), F.date_format("snapshot_date", "yyyyMMdd")).alias("file_name"),
               "entries").write.mode("overwrite").json(path)


def append_snapshots(entries: DataFrame, path: str) -> None:
    """Add imports to the Parquet history, partitioned by day and import.

    Dynamic partition overwrite, set on this writer alone, makes a replayed
    import replace its own rows only; other imports of the same day stay.
    ``entries`` has ``snapshot_date``; without ``import_id`` the day is the import.
    """
    if "import_id" not in entries.columns:
        entries = entries.withColumn("import_id", F.date_format("snapshot_date", "yyyyMMdd"))
    (entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("snapshot_date", "import_id").parquet(path))


def append_summaries(summaries: DataFrame, path: str) -> None:
    """Keep the mergeable summaries of new snapshots (``velocity.snapshot_summaries``), partitioned by day; a
    replayed snapshot replaces its own."""
    (summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("snapshot_date").parquet(path))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_import_log(log: DataFrame, path: str) -> None:
    """Append import-log rows (one per import)."""
    log.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_import_log(spark: SparkSession, path: str, key: str = "timestamp") -> DataFrame:
    """The log with one row per import: a replayed import shows its last row."""
    log = spark.read.parquet(path)
    columns = [c for c in log.columns if c != "logged_at"]
    last = log.groupBy(key).agg(F.max_by(F.struct(*columns), "logged_at").alias("r"))
    return last.select(*[F.col(f"r.`{c}`").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The listed columns as CSV with a header."""
    (df.select(*(columns or df.columns)).write.mode("overwrite")
       .option("header", True).csv(path))


def write_report(results: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One directory per named result under one report path."""
    for name, df in results.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(f"{path}/{name}")
        else:
            w.format(fmt).save(f"{path}/{name}")
