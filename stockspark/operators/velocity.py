"""Velocity: how fast each package moves across successive snapshots.

History rows are entries ``(snapshot_date, entry_idx, barcode, room, qty)``;
a barcode listed in two rooms in one snapshot contributes two entries, and
"consecutive" means consecutive in (snapshot, entry) order.

Plan, built for a hot barcode (one package may own a large share of rows):

1. per (barcode, snapshot): entry count, first / last room and qty, room
   changes inside the snapshot, and the trailing run of equal qty. The only
   window here is partitioned by (barcode, snapshot), so a hot barcode is
   split across snapshots.
2. per barcode over those summaries (at most one row per snapshot, bounded
   by the retention): boundary room changes, the global unchanged-qty
   streak, first qty, first snapshot.
Scores and rates round like Python's ``round`` (exact binary value, ties to
even) through ``functions.numeric.py_round``.

3. a full outer join of the current rows (one per barcode) with (2) gives the
   tracked items and the sold-out ones. Both sides have one row per barcode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.functions.numeric import py_round
from stockspark.schema import (VELOCITY_FAST_THRESHOLD, VELOCITY_QTY_WEIGHT,
                               VELOCITY_ROOM_WEIGHT, VELOCITY_SLOW_THRESHOLD)

SNAP = "snapshot_date"


def snapshot_build(inv: DataFrame, snapshot_col: Column | None = None,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Snapshot entries of an inventory: barcode trimmed and non-empty,
    room lower-cased and trimmed, integer qty, received date."""
    from stockspark.functions.parse import to_qty
    bc = F.trim(F.col("package_barcode").cast("string"))
    out = inv.select(
        *keep,
        *([snapshot_col.alias(SNAP)] if snapshot_col is not None else []),
        bc.alias("barcode"),
        F.lower(F.trim(F.col("room"))).alias("room"),
        to_qty(F.col("qty_on_hand")).alias("qty"),
        F.col("received_date"))
    return out.where(F.col("barcode").isNotNull() & (F.col("barcode") != "")
                     & (F.lower(F.col("barcode")) != "nan"))


def _seconds(snap: str) -> Column:
    """A snapshot's date or time as seconds."""
    return F.col(snap).cast("timestamp").cast("long")


def _elapsed_days(snap: str) -> Column:
    """max(whole elapsed days between the first and last snapshot, 1)."""
    elapsed = F.floor((F.max(_seconds(snap)) - F.min(_seconds(snap))) / 86400)
    return F.greatest(elapsed, F.lit(1)).cast("int")


def history_span_days(history: DataFrame, snap: str = SNAP) -> Column:
    """Elapsed days of the whole history: a scalar subquery (evaluated once, not joined)."""
    return history.select(_elapsed_days(snap)).scalar()


SEGMENT_ROWS = 100_000


def _segment(segment_rows: int, snap: str) -> Column:
    """Sortable long: (snapshot second, entry block) -> second * 2**20 + block."""
    return _seconds(snap) * (1 << 20) + F.floor(F.col("entry_idx") / segment_rows).cast("long")


def snapshot_summaries(history: DataFrame, segment_rows: int = SEGMENT_ROWS, snap: str = SNAP,
                       keys: tuple[str, ...] = ()) -> DataFrame:
    """Step 1: one row per (keys, barcode, segment); a segment is a block of at most
    ``segment_rows`` consecutive entries of one snapshot, so even a barcode
    holding a large share of a snapshot is split into bounded window groups.
    ``snap`` is the column that identifies a snapshot (its date, or its time
    where several imports fall on one day)."""
    w = Window.partitionBy(*keys, "barcode", "_seg").orderBy("entry_idx")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = (history.where(F.col("barcode").isNotNull() & (F.col("barcode") != ""))
                .select(*keys, "barcode", snap, "entry_idx", "room", "qty")
                .withColumn("_seg", _segment(segment_rows, snap))
                .withColumn("_prev_room", F.lag("room").over(w))
                .withColumn("_rn", F.row_number().over(w))
                .withColumn("_last_qty", F.last("qty").over(wall)))
    return h.groupBy(*keys, "barcode", "_seg").agg(
        F.min(snap).alias(snap),
        F.count(F.lit(1)).alias("n_s"),
        F.count_if(F.col("_prev_room").isNotNull() & (F.col("room") != F.col("_prev_room")))
         .alias("changes_s"),
        F.min_by("room", "entry_idx").alias("first_room_s"),
        F.max_by("room", "entry_idx").alias("last_room_s"),
        F.min_by("qty", "entry_idx").alias("first_qty_s"),
        F.max_by("qty", "entry_idx").alias("last_qty_s"),
        (F.count(F.lit(1)) - F.coalesce(F.max(F.when(F.col("qty") != F.col("_last_qty"), F.col("_rn"))),
                                        F.lit(0))).alias("tail_s"))


def barcode_history(history: DataFrame, segment_rows: int = SEGMENT_ROWS, snap: str = SNAP,
                    keys: tuple[str, ...] = ()) -> DataFrame:
    """Step 2: one row per (keys, barcode): entries, room changes (W1), first qty,
    last qty, unchanged-qty streak (W4), first snapshot. Windows here run
    over the segment summaries of one barcode (bounded by snapshots x
    blocks), never over its raw entries."""
    return merge_summaries(snapshot_summaries(history, segment_rows, snap, keys), snap, keys)


def merge_summaries(s: DataFrame, snap: str = SNAP, keys: tuple[str, ...] = ()) -> DataFrame:
    """Step 2 over summaries, those just made or those kept in storage import by import.

    A summary says all that later ones need of its entries (first and last room and qty, changes, trailing run), so
    velocity after a new import reads that import and the summaries, not the history."""
    w = Window.partitionBy(*keys, "barcode").orderBy("_seg")
    wall = Window.partitionBy(*keys, "barcode")
    s = (s.withColumn("_prev_last_room", F.lag("last_room_s").over(w))
          .withColumn("_L", F.max_by("last_qty_s", "_seg").over(wall)))
    full = (F.col("tail_s") == F.col("n_s")) & (F.col("last_qty_s") == F.col("_L"))
    # the newest segment that is not entirely equal to the last qty breaks the run
    s = s.withColumn("_break", F.max(F.when(~full, F.col("_seg"))).over(wall))
    after_break = F.sum(F.when(F.col("_break").isNull() | (F.col("_seg") > F.col("_break")),
                               F.col("n_s")).otherwise(0))
    at_break = F.coalesce(F.max(F.when((F.col("_seg") == F.col("_break"))
                                       & (F.col("last_qty_s") == F.col("_L")), F.col("tail_s"))),
                          F.lit(0))
    agg = s.groupBy(*keys, "barcode").agg(
        F.sum("n_s").cast("long").alias("n_entries"),
        (F.sum("changes_s") + F.count_if(F.col("_prev_last_room").isNotNull()
                                         & (F.col("first_room_s") != F.col("_prev_last_room"))))
        .cast("long").alias("room_changes"),
        F.min_by("first_qty_s", "_seg").alias("first_qty"),
        F.max_by("last_qty_s", "_seg").alias("last_qty"),
        F.max_by("last_room_s", "_seg").alias("last_room"),
        F.min(snap).alias("first_snapshot"),
        F.max(snap).alias("last_snapshot"),
        (after_break + at_break).cast("long").alias("_run"))
    streak = F.when(F.col("n_entries") < 2, F.lit(0).cast("long")).otherwise(F.col("_run") - 1)
    return agg.select(*keys, "barcode", "n_entries", "room_changes", "first_qty", "last_qty", "last_room",
                      "first_snapshot", "last_snapshot", streak.alias("qty_unchanged_streak"))


def _first_per_barcode(current: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    cols = [c for c in current.columns if c not in ("barcode", order, *keys)]
    cur = current.where(F.col("barcode").isNotNull() & (F.trim("barcode") != "")
                        & (F.lower(F.trim("barcode")) != "nan"))
    cur = cur.withColumn("barcode", F.trim("barcode"))
    return cur.groupBy(*keys, "barcode").agg(
        *[F.min_by(c, order).alias(c) for c in cols])


LAST_ENTRY = ["room", "last_qty", "last_seen"]


def velocity_metrics(current: DataFrame, history: DataFrame, as_of, slow_threshold: int =
                     VELOCITY_SLOW_THRESHOLD, order: str = "entry_idx", snap: str = SNAP,
                     keys: tuple[str, ...] = (), last_entry: bool = False, summarised: bool = False) -> DataFrame:
    """Per barcode room_changes, qty_delta, sell_rate, stock_age_days,
    qty_unchanged_streak, velocity_score, velocity_label.

    ``current`` needs ``barcode``, ``qty`` and an ``order`` column (first row
    per barcode supplies the current qty); ``received_date`` is optional. With
    ``keys`` (``("store",)``) every group has its own history and its own span
    of days. ``last_entry`` adds room, qty and snapshot of the last entry.
    ``summarised``: ``history`` holds the rows of ``snapshot_summaries`` instead of entries.
    """
    if "received_date" not in current.columns:
        current = current.withColumn("received_date", F.lit(None).cast("date"))
    cur = _first_per_barcode(current.select(*keys, "barcode", "qty", "received_date", order), order, keys)
    hist = merge_summaries(history, snap, keys) if summarised else barcode_history(history, snap=snap, keys=keys)
    j = cur.withColumn("_in_cur", F.lit(True)).join(hist, [*keys, "barcode"], "full_outer")
    if keys:
        j = j.join(history.groupBy(*keys).agg(_elapsed_days(snap).alias("_days")), list(keys), "left")
        days = F.coalesce(F.col("_days"), F.lit(1))
    else:
        days = history_span_days(history, snap)
    n = F.coalesce(F.col("n_entries"), F.lit(0))
    cur_qty = F.col("qty")
    first_qty = F.coalesce(F.col("first_qty"), cur_qty)
    delta = cur_qty - first_qty
    as_of_d = F.lit(as_of).cast("date")
    age_recv = F.datediff(as_of_d, F.col("received_date"))
    age = F.coalesce(F.nullif(age_recv, F.lit(0)), F.datediff(as_of_d, F.col("first_snapshot").cast("date")),
                     age_recv, F.lit(0))
    changes = F.coalesce(F.col("room_changes"), F.lit(0).cast("long"))
    room_score = F.least(changes / F.greatest(n - 1, F.lit(1)), F.lit(1.0))
    qty_score = F.least(F.abs(delta) / F.greatest(F.abs(first_qty), F.lit(1)), F.lit(1.0))
    raw_score = room_score * VELOCITY_ROOM_WEIGHT + qty_score * VELOCITY_QTY_WEIGHT
    streak = F.coalesce(F.col("qty_unchanged_streak"), F.lit(0).cast("long"))
    tracked = F.col("_in_cur").isNotNull()
    # raw values first, rounded in a second projection: py_round refers to
    # its input many times, so the input must be a column, not an expression
    raw = j.select(
        *keys, "barcode", F.col("last_room").alias("room"), "last_qty", F.col("last_snapshot").alias("last_seen"),
        tracked.alias("_tracked"), n.alias("_n"),
        changes.alias("room_changes"),
        F.when(tracked, delta).otherwise(-F.col("first_qty")).cast("long").alias("qty_delta"),
        F.when(tracked, -delta / days).otherwise(F.col("first_qty") / days).alias("_rate"),
        F.when(tracked, age).otherwise(F.lit(0)).cast("long").alias("stock_age_days"),
        F.when(tracked, streak).otherwise(F.lit(0).cast("long")).alias("qty_unchanged_streak"),
        raw_score.alias("_score"))
    n_, tr = F.col("_n"), F.col("_tracked")
    score = py_round(F.col("_score"), 3)
    st = F.col("qty_unchanged_streak")
    label = (F.when(n_ <= 1, "New")
              .when(st >= slow_threshold * 2, "Stale")
              .when(st >= slow_threshold, "Slow")
              .when(score >= VELOCITY_FAST_THRESHOLD, "Fast")
              .otherwise("Moderate"))
    return raw.select(
        *keys, "barcode", "room_changes", "qty_delta",
        F.when(tr & (n_ < 2), F.lit(0.0)).otherwise(py_round(F.col("_rate"), 2)).alias("sell_rate"),
        "stock_age_days", "qty_unchanged_streak",
        F.when(tr, F.when(n_ <= 1, F.lit(0.0)).otherwise(score)).otherwise(F.lit(1.0)).alias("velocity_score"),
        F.when(tr, label).otherwise(F.lit("Sold Out")).alias("velocity_label"),
        *(LAST_ENTRY if last_entry else []))


def room_movement(history: DataFrame, snap: str = SNAP, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per barcode, the snapshots where its room differs from the room of
    the previous snapshot it was seen in (first entry per snapshot)."""
    first = history.groupBy(*keys, "barcode", snap).agg(F.min_by("room", "entry_idx").alias("room"))
    w = Window.partitionBy(*keys, "barcode").orderBy(snap)
    return (first.withColumn("from_room", F.lag("room").over(w))
                 .where(F.col("from_room").isNotNull() & (F.col("room") != F.col("from_room")))
                 .select(*keys, "barcode", snap, "from_room", F.col("room").alias("to_room")))


def velocity_detail(vel: DataFrame, current: DataFrame, order: str = "entry_idx") -> DataFrame:
    """Velocity rows with the first current row of their barcode."""
    cur = _first_per_barcode(current, order)
    return vel.join(cur, "barcode", "left")


def slow_movers(vel: DataFrame, current: DataFrame, order: str = "entry_idx") -> DataFrame:
    """Slow and Stale items with their current details."""
    return velocity_detail(vel.where(F.col("velocity_label").isin("Slow", "Stale")), current, order)


def sold_out(current: DataFrame, history: DataFrame, snap: str = SNAP) -> DataFrame:
    """Items of the history that are not current: their velocity columns (W6) with room, qty and snapshot of their
    last entry. Only the entries of such barcodes are summarised; the history is otherwise read for its span alone."""
    held = current.select(F.trim("barcode").alias("barcode")).where(F.col("barcode").isNotNull()).distinct()
    gone = barcode_history(history.join(held, "barcode", "left_anti"), snap=snap)
    days = history_span_days(history, snap)
    zero = F.lit(0).cast("long")
    raw = gone.select("barcode", "room_changes", (-F.col("first_qty")).cast("long").alias("qty_delta"),
                      (F.col("first_qty") / days).alias("_rate"), F.col("last_room").alias("room"), "last_qty",
                      F.col("last_snapshot").alias("last_seen"))
    return raw.select("barcode", "room_changes", "qty_delta", py_round(F.col("_rate"), 2).alias("sell_rate"),
                      zero.alias("stock_age_days"), zero.alias("qty_unchanged_streak"), F.lit(1.0).alias("velocity_score"),
                      F.lit("Sold Out").alias("velocity_label"), *LAST_ENTRY)


def velocity_labels(items: DataFrame, vel: DataFrame, barcode_col: str = "package_barcode") -> DataFrame:
    """Attach the velocity label of each row's barcode; unknown -> "New"."""
    lab = vel.select(F.col("barcode").alias("_vb"), F.col("velocity_label").alias("_vl"))
    return (items.join(lab, F.trim(F.col(barcode_col)) == F.col("_vb"), "left")
                 .withColumn("velocity", F.coalesce("_vl", F.lit("New"))).drop("_vb", "_vl"))


def velocity_overview(vel: DataFrame, history: DataFrame) -> DataFrame:
    """Items, count per label, slow incl. stale, average sell rate of
    active items (not New / Sold Out), snapshot count and date range."""
    lab = F.col("velocity_label")
    v = vel.agg(
        F.count(F.lit(1)).alias("total_tracked"),
        F.count_if(lab == "Fast").alias("fast_count"),
        F.count_if(lab == "Moderate").alias("moderate_count"),
        F.count_if(lab.isin("Slow", "Stale")).alias("slow_count"),
        F.count_if(lab == "Stale").alias("stale_count"),
        F.count_if(lab == "New").alias("new_count"),
        F.count_if(lab == "Sold Out").alias("sold_out_count"),
        py_round(F.avg(F.when(~lab.isin("New", "Sold Out"), F.col("sell_rate"))), 2).alias("avg_sell_rate"))
    snaps = history.select(F.countDistinct(SNAP)).scalar()
    first = history.select(F.min(SNAP)).scalar()
    last = history.select(F.max(SNAP)).scalar()
    return v.select("*", snaps.alias("snapshot_count"), first.alias("first_snapshot"),
                    last.alias("last_snapshot"))


def snapshot_list(history: DataFrame, by: tuple[str, ...] = (SNAP,)) -> DataFrame:
    """One row per snapshot with its entry count; ``by`` names what
    identifies a snapshot (date, or store, time, import and file)."""
    return history.groupBy(*by).agg(F.count(F.lit(1)).alias("items"))
