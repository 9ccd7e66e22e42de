"""Registered queries: velocity over the snapshot history."""

from __future__ import annotations


from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.operators import velocity as vl
from stockspark.plans.registry import register
from stockspark.plans.restock_queries import MU_SQL
from stockspark.plans.views import IMPORT_ENTRY, py_round_sql, with_views
from stockspark.session import scratch_path
from stockspark.sources import history_io as hio

AS_OF = fx.VELOCITY_AS_OF.isoformat()
T = 3  # slow threshold (fixed fixture parameter)

_HB = """
select barcode, count(*) as n_entries,
       count(*) filter (where prev_room is not null and room <> prev_room) as room_changes,
       arg_min(qty, rn) as first_qty, min(snapshot_date) as first_snapshot,
       count(*) - coalesce(max(rn) filter (where qty <> lastq), 0) as run
from (select barcode, snapshot_date, entry_idx, room, qty,
             lag(room) over w as prev_room, row_number() over w as rn,
             last_value(qty) over (partition by barcode order by snapshot_date, entry_idx
                                   rows between unbounded preceding and unbounded following) as lastq
      from snapshot_entry where barcode is not null and barcode <> ''
      window w as (partition by barcode order by snapshot_date, entry_idx)) h
group by barcode"""
_DAYS = "(select greatest(date_diff('day', min(snapshot_date), max(snapshot_date)), 1) from snapshot_entry)"
_VEL = f"""
select barcode, room_changes, qty_delta, sell_rate, stock_age_days, qty_unchanged_streak,
       velocity_score, velocity_label
from (
  select barcode, room_changes, qty_delta, stock_age_days, qty_unchanged_streak, n, run, cb,
         case when cb is not null and coalesce(n, 0) < 2 then 0.0
              else {py_round_sql("rate_raw", 2)} end as sell_rate,
         case when cb is null then 1.0 when coalesce(n, 0) <= 1 then 0.0
              else {py_round_sql("score_raw", 3)} end as velocity_score
  from (
    select coalesce(c.barcode, hb.barcode) as barcode,
           cast(coalesce(hb.room_changes, 0) as bigint) as room_changes,
           cast(case when c.barcode is not null then c.qty - coalesce(hb.first_qty, c.qty)
                     else -hb.first_qty end as bigint) as qty_delta,
           case when c.barcode is null then hb.first_qty / {_DAYS}
                else -(c.qty - coalesce(hb.first_qty, c.qty)) / {_DAYS} end as rate_raw,
           cast(case when c.barcode is null then 0
                     else coalesce(date_diff('day', hb.first_snapshot, date '{AS_OF}'), 0) end as bigint)
             as stock_age_days,
           cast(case when c.barcode is null or coalesce(hb.n_entries, 0) < 2 then 0
                     else hb.run - 1 end as bigint) as qty_unchanged_streak,
           least(coalesce(hb.room_changes, 0) / greatest(hb.n_entries - 1, 1), 1.0) * 0.3
             + least(abs(c.qty - hb.first_qty) / greatest(abs(hb.first_qty), 1), 1.0) * 0.7 as score_raw,
           hb.n_entries as n, hb.run as run, c.barcode as cb
    from current_items c full outer join hb on c.barcode = hb.barcode) v0) v1,
lateral (select case when cb is null then 'Sold Out'
                     when coalesce(n, 0) <= 1 then 'New'
                     when run - 1 >= {2 * T} then 'Stale'
                     when run - 1 >= {T} then 'Slow'
                     when velocity_score >= 0.25 then 'Fast'
                     else 'Moderate' end as velocity_label) l"""


def _sql(body: str, *names: str, extra=()) -> str:
    return with_views(body, "current_items", *names, extra=[("hb", _HB), ("vel", _VEL), *extra])


def _hist(spark, sf_dir):
    return fx.snapshot_entry(spark, sf_dir)


def _vel(spark, sf_dir):
    h = _hist(spark, sf_dir)
    cur = fx.current_items(spark, sf_dir, h)
    return vl.velocity_metrics(cur, h, fx.VELOCITY_AS_OF, T)


@register("velocity_metrics", _sql("select * from vel"))
def q_velocity_metrics(spark, sf_dir):
    return _vel(spark, sf_dir)


@register("room_changes", _sql("select barcode, room_changes from vel"))
def q_room_changes(spark, sf_dir):
    return _vel(spark, sf_dir).select("barcode", "room_changes")


@register("sell_rate", _sql("select barcode, qty_delta, sell_rate from vel"))
def q_sell_rate(spark, sf_dir):
    return _vel(spark, sf_dir).select("barcode", "qty_delta", "sell_rate")


@register("stock_age", _sql("select barcode, stock_age_days from vel"))
def q_stock_age(spark, sf_dir):
    return _vel(spark, sf_dir).select("barcode", "stock_age_days")


@register("qty_streak", _sql("select barcode, qty_unchanged_streak from vel"))
def q_qty_streak(spark, sf_dir):
    return _vel(spark, sf_dir).select("barcode", "qty_unchanged_streak")


@register("room_movement", with_views("""
select barcode, snapshot_date, from_room, to_room from (
  select barcode, snapshot_date, room as to_room,
         lag(room) over (partition by barcode order by snapshot_date) as from_room
  from (select barcode, snapshot_date, arg_min(room, entry_idx) as room
        from snapshot_entry group by barcode, snapshot_date) t) u
where from_room is not null and to_room <> from_room""", "snapshot_entry"))
def q_room_movement(spark, sf_dir):
    return vl.room_movement(_hist(spark, sf_dir))


@register("snapshot_build", with_views("""
select trim(package_barcode) as barcode, lower(trim(room)) as room, qty_on_hand as qty, received_date
from inventory
where package_barcode is not null and trim(package_barcode) <> '' and lower(trim(package_barcode)) <> 'nan'
""", "inventory"))
def q_snapshot_build(spark, sf_dir):
    return vl.snapshot_build(fx.inventory(spark, sf_dir))


_DETAIL = "select v.*, c.snapshot_date, c.room, c.qty from vel v left join current_items c using (barcode)"


@register("velocity_detail", _sql(_DETAIL))
def q_velocity_detail(spark, sf_dir):
    h = _hist(spark, sf_dir)
    cur = fx.current_items(spark, sf_dir, h)
    return vl.velocity_detail(vl.velocity_metrics(cur, h, fx.VELOCITY_AS_OF, T), cur)


@register("slow_movers", _sql(f"select * from ({_DETAIL}) d where velocity_label in ('Slow', 'Stale')"))
def q_slow_movers(spark, sf_dir):
    h = _hist(spark, sf_dir)
    cur = fx.current_items(spark, sf_dir, h)
    return vl.slow_movers(vl.velocity_metrics(cur, h, fx.VELOCITY_AS_OF, T), cur)


@register("sold_out", _sql("""
select v.*, l.room, l.last_qty, l.last_seen
from vel v left join (
  select barcode, arg_max(room, (snapshot_date, entry_idx)) as room,
         arg_max(qty, (snapshot_date, entry_idx)) as last_qty,
         max(snapshot_date) as last_seen
  from snapshot_entry group by barcode) l using (barcode)
where v.velocity_label = 'Sold Out'"""))
def q_sold_out(spark, sf_dir):
    h = _hist(spark, sf_dir)
    cur = fx.current_items(spark, sf_dir, h)
    return vl.sold_out(cur, h)


@register("velocity_incremental", _sql("select * from vel"))
def q_velocity_incremental(spark, sf_dir):
    """W1-W6 import by import: earlier snapshots are stored as summaries; the newest import alone is read
    and summarised, then all summaries are merged."""
    h = _hist(spark, sf_dir)
    cur = fx.current_items(spark, sf_dir, h)
    newest = h.select(F.max("snapshot_date")).scalar()
    path = scratch_path(spark, "velocity-summaries")
    hio.append_summaries(vl.snapshot_summaries(h.where(F.col("snapshot_date") < newest)), path)
    hio.append_summaries(vl.snapshot_summaries(h.where(F.col("snapshot_date") == newest)), path)
    return vl.velocity_metrics(cur, spark.read.parquet(path), fx.VELOCITY_AS_OF, T, summarised=True)


@register("velocity_overview", _sql(f"""
select count(*) as total_tracked,
       count(*) filter (where velocity_label = 'Fast') as fast_count,
       count(*) filter (where velocity_label = 'Moderate') as moderate_count,
       count(*) filter (where velocity_label in ('Slow', 'Stale')) as slow_count,
       count(*) filter (where velocity_label = 'Stale') as stale_count,
       count(*) filter (where velocity_label = 'New') as new_count,
       count(*) filter (where velocity_label = 'Sold Out') as sold_out_count,
       {py_round_sql("avg(sell_rate) filter (where velocity_label not in ('New', 'Sold Out'))", 2)}
         as avg_sell_rate,
       (select count(distinct snapshot_date) from snapshot_entry) as snapshot_count,
       (select min(snapshot_date) from snapshot_entry) as first_snapshot,
       (select max(snapshot_date) from snapshot_entry) as last_snapshot
from vel"""))
def q_velocity_overview(spark, sf_dir):
    h = _hist(spark, sf_dir)
    cur = fx.current_items(spark, sf_dir, h)
    return vl.velocity_overview(vl.velocity_metrics(cur, h, fx.VELOCITY_AS_OF, T), h)


# velocity of two stores with two imports a day: each store has its own
# history, order is by snapshot time, spans are whole elapsed days
_STORE_VEL = f"""
with h as (
  select *, lag(room) over w as prev_room, row_number() over w as rn,
         last_value(qty) over (partition by store, barcode order by snapshot_ts, entry_idx
                               rows between unbounded preceding and unbounded following) as lastq
  from import_entry window w as (partition by store, barcode order by snapshot_ts, entry_idx)),
hb as (
  select store, barcode, count(*) as n, count(*) filter (where room <> prev_room) as room_changes,
         arg_min(qty, rn) as first_qty, min(snapshot_ts) as first_snapshot,
         count(*) - coalesce(max(rn) filter (where qty <> lastq), 0) as run
  from h group by store, barcode),
span as (
  select store, greatest(floor((epoch(max(snapshot_ts)) - epoch(min(snapshot_ts))) / 86400), 1)::int as days,
         max(snapshot_ts) as newest
  from import_entry group by store),
cur as (
  select e.store, e.barcode, arg_min(qty, entry_idx) as qty
  from import_entry e join span s on e.store = s.store and e.snapshot_ts = s.newest group by e.store, e.barcode),
j as (
  select hb.store, hb.barcode, hb.n, run, room_changes::bigint as room_changes, cur.barcode as cb,
         case when cur.barcode is not null then cur.qty - first_qty else -first_qty end::bigint as qty_delta,
         case when cur.barcode is not null then -(cur.qty - first_qty) / days else first_qty / days end as rate_raw,
         case when cur.barcode is null then 0
              else date_diff('day', cast(first_snapshot as date), date '{AS_OF}') end::bigint as stock_age_days,
         case when cur.barcode is null or hb.n < 2 then 0 else run - 1 end::bigint as qty_unchanged_streak,
         least(room_changes / greatest(hb.n - 1, 1), 1.0) * 0.3
           + least(abs(cur.qty - first_qty) / greatest(abs(first_qty), 1), 1.0) * 0.7 as score_raw
  from hb join span using (store) left join cur using (store, barcode)),
scored as (
  select *, case when cb is not null and n < 2 then 0.0 else {py_round_sql("rate_raw", 2)} end as sell_rate,
         case when cb is null then 1.0 when n <= 1 then 0.0 else {py_round_sql("score_raw", 3)} end as velocity_score
  from j)
select store, barcode, room_changes, qty_delta, sell_rate, stock_age_days, qty_unchanged_streak, velocity_score,
       case when cb is null then 'Sold Out' when n <= 1 then 'New' when run - 1 >= {2 * T} then 'Stale'
            when run - 1 >= {T} then 'Slow' when velocity_score >= 0.25 then 'Fast' else 'Moderate' end
         as velocity_label
from scored"""


def _import_view(body: str) -> str:
    return "with import_entry as (" + IMPORT_ENTRY + "), result as (" + body + ") select * from result"


@register("velocity_by_store", _import_view(_STORE_VEL))
def q_velocity_by_store(spark, sf_dir):
    h = fx.import_entry(spark, sf_dir)
    return vl.velocity_metrics(fx.current_by_store(h), h, fx.VELOCITY_AS_OF, T, snap="snapshot_ts", keys=("store",))


@register("room_movement_by_store", _import_view("""
select store, barcode, snapshot_ts, from_room, to_room from (
  select store, barcode, snapshot_ts, room as to_room,
         lag(room) over (partition by store, barcode order by snapshot_ts) as from_room
  from (select store, barcode, snapshot_ts, arg_min(room, entry_idx) as room
        from import_entry group by store, barcode, snapshot_ts) t) u
where from_room is not null and to_room <> from_room"""))
def q_room_movement_by_store(spark, sf_dir):
    return vl.room_movement(fx.import_entry(spark, sf_dir), "snapshot_ts", ("store",))


@register("import_list", _import_view("""
select store, import_id, snapshot_ts, count(*) as items from import_entry group by store, import_id, snapshot_ts"""))
def q_import_list(spark, sf_dir):
    """A15 with identity: every import of every store, also two on one day."""
    return vl.snapshot_list(fx.import_entry(spark, sf_dir), ("store", "import_id", "snapshot_ts"))


@register("snapshot_list", with_views(
    "select snapshot_date, count(*) as items from snapshot_entry group by snapshot_date", "snapshot_entry"))
def q_snapshot_list(spark, sf_dir):
    return vl.snapshot_list(_hist(spark, sf_dir))


# packages carry barcodes of the history (by part key), a few in twenty unknown ones
_TRACKED = "case when cast(right(trim(package_barcode), 1) as int) = 9 then package_barcode else " \
    "'U' || lpad(cast(cast(substring(trim(package_barcode), 4, 13) as bigint) % {n} + 1 as varchar), 8, '0') end"


@register("move_up_velocity", _sql(f"""
select m.*, coalesce(v.velocity_label, 'New') as velocity
from (select * replace ({_TRACKED.format(n="(select count(distinct barcode) from snapshot_entry)")} as package_barcode) from mu) m
left join vel v on trim(m.package_barcode) = v.barcode""", "work", extra=[("mu", MU_SQL)]))
def q_move_up_velocity(spark, sf_dir):
    """J2 with every label: the move-up packages carry barcodes of the snapshot history."""
    from stockspark.plans.restock_queries import OUT_COLS, move_up_result
    n = _hist(spark, sf_dir).select(F.countDistinct("barcode")).scalar()
    bc = F.trim("package_barcode")
    tracked = F.when(F.right(bc, F.lit(1)) == "9", F.col("package_barcode")).otherwise(F.concat(F.lit("U"), F.lpad(
        (F.substring(bc, 4, 13).cast("long") % n + 1).cast("string"), 8, "0")))
    items = move_up_result(spark, sf_dir).select(*OUT_COLS).withColumn("package_barcode", tracked)
    return vl.velocity_labels(items, _vel(spark, sf_dir))
