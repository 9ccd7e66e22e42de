"""Snapshot history: diffs between imports, floor arrivals, import log,
retention (J8, J9, A16-A18, T4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.functions.rooms import alias_room
from stockspark.operators.restock import drop_incomplete, move_up, move_up_diag
from stockspark.operators.velocity import snapshot_build
from stockspark.schema import SALES_FLOOR_ALIASES

SNAP = "snapshot_date"
FLOOR_SET = ["sales floor", *SALES_FLOOR_ALIASES]


def snapshot_pair(history: DataFrame, snap_a, snap_b) -> DataFrame:
    """Last entry per barcode in snapshot A and in snapshot B, side by side.

    One conditional aggregation (``max_by`` skips rows whose ordering is
    null), so the two snapshots meet without a join."""
    a = F.col(SNAP) == snap_a
    b = F.col(SNAP) == snap_b
    entry = F.struct(F.col("room").alias("room"), F.col("qty").alias("qty"))
    two = history.where(a | b)
    return two.groupBy("barcode").agg(
        F.max_by(entry, F.when(a, F.col("entry_idx"))).alias("ea"),
        F.max_by(entry, F.when(b, F.col("entry_idx"))).alias("eb"))


def snapshot_new(pair: DataFrame) -> DataFrame:
    return pair.where(F.col("ea").isNull() & F.col("eb").isNotNull()).select(
        "barcode", F.col("eb.room").alias("room"), F.col("eb.qty").alias("qty"))


def snapshot_removed(pair: DataFrame) -> DataFrame:
    return pair.where(F.col("ea").isNotNull() & F.col("eb").isNull()).select(
        "barcode", F.col("ea.room").alias("room"), F.col("ea.qty").alias("qty"))


def snapshot_qty_changes(pair: DataFrame) -> DataFrame:
    both = pair.where(F.col("ea").isNotNull() & F.col("eb").isNotNull())
    return both.where(F.col("ea.qty") != F.col("eb.qty")).select(
        "barcode", F.col("eb.room").alias("room"), F.col("ea.qty").alias("qty_a"),
        F.col("eb.qty").alias("qty_b"), (F.col("eb.qty") - F.col("ea.qty")).alias("delta"))


def snapshot_room_moves(pair: DataFrame) -> DataFrame:
    both = pair.where(F.col("ea").isNotNull() & F.col("eb").isNotNull())
    moved = F.lower(F.trim(F.col("ea.room"))) != F.lower(F.trim(F.col("eb.room")))
    return both.where(moved).select(
        "barcode", F.col("ea.room").alias("from_room"), F.col("eb.room").alias("to_room"),
        F.col("eb.qty").alias("qty"))


def snapshot_diff_summary(pair: DataFrame) -> DataFrame:
    """The four counts and the net qty change over barcodes in both."""
    ea, eb = F.col("ea"), F.col("eb")
    both = ea.isNotNull() & eb.isNotNull()
    changed = both & (F.col("ea.qty") != F.col("eb.qty"))
    return pair.agg(
        F.count_if(ea.isNull() & eb.isNotNull()).alias("new"),
        F.count_if(ea.isNotNull() & eb.isNull()).alias("removed"),
        F.count_if(changed).alias("qty_changed"),
        F.count_if(both & (F.lower(F.trim(F.col("ea.room"))) != F.lower(F.trim(F.col("eb.room")))))
         .alias("room_moved"),
        F.coalesce(F.sum(F.when(changed, F.col("eb.qty") - F.col("ea.qty"))), F.lit(0)).cast("long")
         .alias("net_qty"))


def snapshot_order(history: DataFrame, snap: str = SNAP, keys: Sequence[str] = ()) -> DataFrame:
    """Position of every snapshot within its group (one row per snapshot)."""
    snaps = history.select(*keys, snap).distinct()
    return snaps.withColumn("snap_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(snap)))


def last_rooms(history: DataFrame, by: Sequence[str], aliases: dict | None = None) -> DataFrame:
    """``*by, barcode, room``: each barcode's last room per snapshot, aliased and lower-cased."""
    return history.groupBy(*by, "barcode").agg(
        F.lower(alias_room(F.max_by("room", "entry_idx"), aliases)).alias("room"))


def arrived(prev_room: str, room: str, floor_rooms: Sequence[str] = FLOOR_SET) -> Column:
    """Off the floor before, on it now."""
    floor = [r.strip().lower() for r in floor_rooms]
    return F.col(prev_room).isNotNull() & ~F.col(prev_room).isin(floor) & F.col(room).isin(floor)


def floor_arrivals(history: DataFrame, floor_rooms: Sequence[str] = FLOOR_SET,
                   aliases: dict | None = None, snap: str = SNAP, keys: Sequence[str] = ()) -> DataFrame:
    """Per snapshot, barcodes whose room was off the floor in the
    previous snapshot and is on it now (rooms aliased, lower-cased; last
    entry per barcode wins). ``snap`` identifies a snapshot within ``keys``."""
    last = last_rooms(history, (*keys, snap), aliases)
    last = last.join(snapshot_order(history, snap, keys), [*keys, snap])
    prev = last.select(*keys, "barcode", (F.col("snap_pos") + 1).alias("snap_pos"),
                       F.col("room").alias("prev_room"))
    j = last.join(prev, [*keys, "barcode", "snap_pos"], "left")
    return j.groupBy(*keys, snap).agg(F.count_if(arrived("prev_room", "room", floor_rooms)).alias("floor_arrivals"))


SUMMARY = ["total_rows", "mapped_rows", "move_up_count", "unique_brands", "unique_types", "unique_rooms",
           "total_qty", "velocity_entries_count"]


def import_summary(inv: DataFrame, move_up: DataFrame, raw: DataFrame | None = None,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Raw / mapped / move-up rows, distinct brands, types, rooms, total
    qty and snapshot entries, one row per ``keys`` group (an import).

    ``raw``: the rows before cleaning (default: ``inv``). All inputs are
    aggregated before they meet (union + sum; no join)."""
    bc = F.trim(F.col("package_barcode"))
    zero = F.lit(0).cast("long")

    def part(df: DataFrame, **aggs: Column) -> DataFrame:
        return df.groupBy(*keys).agg(*[aggs.get(c, zero).alias(c) for c in SUMMARY])
    rows = F.count(F.lit(1))
    parts = [
        part(inv, mapped_rows=rows, unique_brands=F.countDistinct("brand"), unique_types=F.countDistinct("type"),
             unique_rooms=F.countDistinct("room"),
             total_qty=F.coalesce(F.sum("qty_on_hand"), zero).cast("long"),
             velocity_entries_count=F.count_if(bc.isNotNull() & (bc != "") & (F.lower(bc) != "nan"))),
        part(inv if raw is None else raw, total_rows=rows),
        part(move_up, move_up_count=rows)]
    return (reduce(DataFrame.unionByName, parts).groupBy(*keys)
            .agg(*[F.sum(c).cast("long").alias(c) for c in SUMMARY]))


# ---- fixed values: what identifies an import, and its diagnostics in the log
IMPORT = ["store", "import_id", "import_ts"]
DIAGNOSTICS = ["total_loaded", "after_dropna", "after_brand", "after_type", "candidate_pool", "removed_as_on_sf",
               "move_up"]


def import_log(raw: DataFrame, candidate_rooms: Sequence[str], order: Column, aliases: dict | None = None,
               floor_rooms: Sequence[str] = FLOOR_SET, arrivals: bool = True) -> DataFrame:
    """M5: one log row per import of ``raw`` (inventory rows with the ``IMPORT``
    columns): summary, move-up diagnostics, and barcodes that came to the floor
    since the store's import before (0 without ``arrivals``, for imports whose
    earlier ones are stored elsewhere)."""
    inv = drop_incomplete(raw)
    summary = import_summary(inv, move_up(raw, candidate_rooms, aliases, keys=IMPORT), raw, IMPORT)
    diag = move_up_diag(raw, candidate_rooms, aliases, keys=IMPORT).select(
        *IMPORT, F.create_map(*[x for c in DIAGNOSTICS for x in (F.lit(c), F.col(c))]).alias("diag"))
    zero = F.lit(0).cast("long")
    log = summary.join(diag, IMPORT, "left")
    if arrivals:
        entries = snapshot_build(inv.withColumn("entry_idx", order), keep=(*IMPORT, "entry_idx"))
        log = log.join(floor_arrivals(entries, floor_rooms, aliases, "import_ts", ["store"]), ["store", "import_ts"], "left")
    else:
        log = log.withColumn("floor_arrivals", zero)
    return (log.select(
        F.col("import_ts").alias("timestamp"), "store", "import_id",
        F.concat("import_id", F.lit(".csv")).alias("file_name"), *SUMMARY, "diag",
        F.coalesce("floor_arrivals", zero).alias("floor_move_ups")))


# ---- fixed values: trend metrics of the import log (order as displayed)
TREND_METRICS = ["total_rows", "move_up_count", "unique_brands", "unique_types", "total_qty",
                 "candidate_pool", "removed_as_on_sf", "floor_move_ups"]


def import_trends(log: DataFrame) -> DataFrame:
    """Per metric latest, min and max over the imports (two metrics
    come from the diagnostics map)."""
    vals = []
    for m in TREND_METRICS:
        if m in ("candidate_pool", "removed_as_on_sf"):
            v = F.coalesce(F.col("diag")[m], F.lit(0).cast("long"))
        else:
            v = F.coalesce(F.col(m), F.lit(0))
        vals.append(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")))
    long = log.select("timestamp", "file_name", F.explode(F.array(*vals)).alias("m")).select(
        "timestamp", "file_name", "m.metric", "m.value")
    return long.groupBy("metric").agg(
        F.max_by("value", F.struct("timestamp", "file_name")).alias("latest"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.count(F.lit(1)).alias("imports"))


def retain_snapshots(history: DataFrame, cutoff) -> DataFrame:
    """T4: keep snapshots at or after ``cutoff``. On a history partitioned by
    snapshot date this prunes whole partitions at the scan."""
    return history.where(F.col(SNAP) >= F.lit(cutoff).cast(history.schema[SNAP].dataType)
                         if not isinstance(cutoff, Column) else F.col(SNAP) >= cutoff)


# ---- fixed values: retention defaults (days); 0 disables the purge
DEFAULT_RETENTION_DAYS = 90
PURGE_OLD_DAYS = 30


def purge_older_than(history: DataFrame, days: int, as_of, ts_col: str = SNAP) -> DataFrame:
    """T4: keep rows whose time is at or after ``as_of - days``; ``days`` <= 0
    keeps everything (retention disabled)."""
    if not days or days <= 0:
        return history
    cutoff = F.date_sub(F.lit(as_of).cast("date"), int(days))
    col = F.col(ts_col)
    return history.where(col >= (cutoff if dict(history.dtypes)[ts_col] == "date" else cutoff.cast("timestamp")))


def purge_all(history: DataFrame) -> DataFrame:
    """T4: the empty history (same schema)."""
    return history.where(F.lit(False))


def purged_count(history: DataFrame, kept: DataFrame, key: str = SNAP) -> DataFrame:
    """How many snapshots (distinct ``key`` values) a purge removes."""
    before = history.select(key).distinct().select(F.lit(1).alias("_one"), F.lit(1).alias("_b"))
    after = kept.select(key).distinct().select(F.lit(1).alias("_one"), F.lit(-1).alias("_b"))
    return before.unionByName(after).agg(F.sum("_b").cast("long").alias("removed"))
