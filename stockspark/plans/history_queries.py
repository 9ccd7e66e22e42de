"""Registered queries: snapshot diffs, floor arrivals, import log, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.operators import history as hs
from stockspark.plans.registry import register
from stockspark.plans.views import FLOOR_LIST, IMPORT_ENTRY, room_alias_sql, sql_list, with_views
from stockspark.plans.restock_queries import CANDIDATE_ROOMS, MU_SQL
from stockspark.session import scratch_path
from stockspark.sources import history_io as hio
from stockspark.sources import retention as rt

# ---- fixed values: fixture parameters. In the event-derived history the
# "purchase" room plays the sales floor; retention keeps the last 14 days.
FLOOR = ["purchase"]
RETAIN_DAYS = 14
FLOOR_NAMES = sql_list(hs.FLOOR_SET)


def _hist(spark, sf_dir):
    return fx.snapshot_entry(spark, sf_dir)


def _pair(spark, sf_dir):
    h = _hist(spark, sf_dir)
    first = h.select(F.min("snapshot_date")).scalar()
    last = h.select(F.max("snapshot_date")).scalar()
    return hs.snapshot_pair(h, first, last)


_PAIR = """
select barcode,
       arg_max(room, entry_idx) filter (where snapshot_date = (select min(snapshot_date) from snapshot_entry)) as ra,
       arg_max(qty, entry_idx) filter (where snapshot_date = (select min(snapshot_date) from snapshot_entry)) as qa,
       count(*) filter (where snapshot_date = (select min(snapshot_date) from snapshot_entry)) as na,
       arg_max(room, entry_idx) filter (where snapshot_date = (select max(snapshot_date) from snapshot_entry)) as rb,
       arg_max(qty, entry_idx) filter (where snapshot_date = (select max(snapshot_date) from snapshot_entry)) as qb,
       count(*) filter (where snapshot_date = (select max(snapshot_date) from snapshot_entry)) as nb
from snapshot_entry group by barcode"""


def _psql(body: str) -> str:
    return with_views(body, "snapshot_entry", extra=[("pair", _PAIR)])


@register("snapshot_new", _psql("select barcode, rb as room, qb as qty from pair where na = 0 and nb > 0"))
def q_snapshot_new(spark, sf_dir):
    return hs.snapshot_new(_pair(spark, sf_dir))


@register("snapshot_removed", _psql("select barcode, ra as room, qa as qty from pair where na > 0 and nb = 0"))
def q_snapshot_removed(spark, sf_dir):
    return hs.snapshot_removed(_pair(spark, sf_dir))


@register("snapshot_qty_changes", _psql("""
select barcode, rb as room, qa as qty_a, qb as qty_b, qb - qa as delta
from pair where na > 0 and nb > 0 and qa <> qb"""))
def q_snapshot_qty_changes(spark, sf_dir):
    return hs.snapshot_qty_changes(_pair(spark, sf_dir))


@register("snapshot_room_moves", _psql("""
select barcode, ra as from_room, rb as to_room, qb as qty
from pair where na > 0 and nb > 0 and lower(trim(ra)) <> lower(trim(rb))"""))
def q_snapshot_room_moves(spark, sf_dir):
    return hs.snapshot_room_moves(_pair(spark, sf_dir))


@register("snapshot_diff_summary", _psql("""
select count(*) filter (where na = 0 and nb > 0) as new,
       count(*) filter (where na > 0 and nb = 0) as removed,
       count(*) filter (where na > 0 and nb > 0 and qa <> qb) as qty_changed,
       count(*) filter (where na > 0 and nb > 0 and lower(trim(ra)) <> lower(trim(rb))) as room_moved,
       cast(coalesce(sum(qb - qa) filter (where na > 0 and nb > 0 and qa <> qb), 0) as bigint) as net_qty
from pair"""))
def q_snapshot_diff_summary(spark, sf_dir):
    return hs.snapshot_diff_summary(_pair(spark, sf_dir))


_ARR = f"""
select l.snapshot_date,
       count(*) filter (where p.room is not null and p.room not in ('{"', '".join(FLOOR)}')
                          and l.room in ('{"', '".join(FLOOR)}')) as floor_arrivals
from (select barcode, snapshot_date, lower(trim(arg_max(room, entry_idx))) as room,
             dense_rank() over (order by snapshot_date) as pos
      from snapshot_entry group by barcode, snapshot_date) l
left join (select barcode, lower(trim(arg_max(room, entry_idx))) as room,
                  dense_rank() over (order by snapshot_date) + 1 as pos
           from snapshot_entry group by barcode, snapshot_date) p
  on l.barcode = p.barcode and l.pos = p.pos
group by l.snapshot_date"""


@register("floor_arrivals", with_views(_ARR, "snapshot_entry"))
def q_floor_arrivals(spark, sf_dir):
    return hs.floor_arrivals(_hist(spark, sf_dir), FLOOR)


_IMPORTS = """
select * replace (case when ord_3 % 29 <> 0 then brand end as brand),
       store || '-' || year(received_date) as import_id,
       make_timestamp(year(received_date), 12, 31, 0, 0, 0.0) as import_ts
from inventory"""
_OK = "product_name is not null and brand is not null and package_barcode is not null and room is not null"
_IWORK = f"""
select * replace ({room_alias_sql()} as room) from imports
where {_OK} and not coalesce(lower(type) like '%accessor%', false)"""
_ICAND = f"""
select c.*, exists (select 1 from iwork f where f.import_id = c.import_id and f.brand = c.brand
                      and f.product_name = c.product_name and lower(trim(f.room)) in ({FLOOR_LIST})) as on_floor
from iwork c where trim(c.room) in ({sql_list(CANDIDATE_ROOMS)})"""
_IARR = f"""
with last as (
  select store, import_ts, trim(package_barcode) as barcode,
         lower({room_alias_sql("lower(trim(arg_max(room, (ord_1, ord_2, ord_3, ord_4, ord_5, ord_6))))")}) as room
  from imports where {_OK} and trim(package_barcode) <> '' and lower(trim(package_barcode)) <> 'nan'
  group by store, import_ts, trim(package_barcode)),
pos as (select store, import_ts, row_number() over (partition by store order by import_ts) as pos
        from (select distinct store, import_ts from last) d),
placed as (select l.*, pos.pos from last l join pos using (store, import_ts))
select a.store, a.import_ts,
       count(*) filter (where p.room is not null and p.room not in ({FLOOR_NAMES}) and a.room in ({FLOOR_NAMES}))
         as arrivals
from placed a left join placed p on a.store = p.store and a.barcode = p.barcode and a.pos = p.pos + 1
group by a.store, a.import_ts"""
_LOG = f"""
select i.import_ts as timestamp, i.store, i.import_id, i.import_id || '.csv' as file_name, total_rows, mapped_rows,
       coalesce(move_up_count, 0) as move_up_count, unique_brands, unique_types, unique_rooms, total_qty,
       velocity_entries_count, coalesce(candidate_pool, 0) as candidate_pool,
       coalesce(removed_as_on_sf, 0) as removed_as_on_sf, coalesce(arrivals, 0) as floor_move_ups
from (select store, import_id, import_ts, count(*) as total_rows, count(*) filter (where {_OK}) as mapped_rows,
             count(distinct brand) filter (where {_OK}) as unique_brands,
             count(distinct type) filter (where {_OK}) as unique_types,
             count(distinct room) filter (where {_OK}) as unique_rooms,
             cast(coalesce(sum(qty_on_hand) filter (where {_OK}), 0) as bigint) as total_qty,
             count(*) filter (where {_OK} and trim(package_barcode) <> '' and lower(trim(package_barcode)) <> 'nan')
               as velocity_entries_count
      from imports group by store, import_id, import_ts) i
left join (select import_id, count(*) as candidate_pool, count(*) filter (where on_floor) as removed_as_on_sf,
                  count(*) filter (where not on_floor) as move_up_count
           from icand group by import_id) c using (import_id)
left join iarr a on a.store = i.store and a.import_ts = i.import_ts"""
_IVIEWS = [("imports", _IMPORTS), ("iwork", _IWORK), ("icand", _ICAND), ("iarr", _IARR), ("log", _LOG)]


def _isql(body: str) -> str:
    return with_views(body, "inventory", extra=_IVIEWS)


_IMPORT_COLS = ["store", "import_id", "import_ts", "type", "brand", "product_name", "package_barcode", "room", "qty_on_hand",
                "received_date", *fx.ORD_COLS]


def _written(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _log(spark, sf_dir):
    # the log reads its rows in many branches: the tables are joined for them once
    raw = _written(fx.import_inventory(spark, sf_dir).select(*_IMPORT_COLS), "import-rows")
    return hs.import_log(raw, CANDIDATE_ROOMS, fx.ord_key(), fx.ROOM_ALIASES)


IMPORT_LOG_SQL = _isql("select * from log")


def import_log_columns(log):
    """The log with the two counts of its diagnostics as columns."""
    return log.select("*", F.col("diag")["candidate_pool"].alias("candidate_pool"),
                      F.col("diag")["removed_as_on_sf"].alias("removed_as_on_sf")).drop("diag")


@register("import_timeline", IMPORT_LOG_SQL)
def q_import_timeline(spark, sf_dir):
    return import_log_columns(_log(spark, sf_dir)).orderBy("timestamp", "store")


_TRENDS = " union all ".join(
    f"select '{m}' as metric, arg_max({m}::double, (timestamp, file_name)) as latest, min({m}::double) as min_value, "
    f"max({m}::double) as max_value, count(*) as imports from log" for m in hs.TREND_METRICS)


@register("import_trends", _isql(_TRENDS))
def q_import_trends(spark, sf_dir):
    return hs.import_trends(_log(spark, sf_dir))


@register("import_summary", with_views("""
select count(*) as total_rows, count(*) as mapped_rows, (select count(*) from mu) as move_up_count,
       count(distinct brand) as unique_brands, count(distinct type) as unique_types,
       count(distinct room) as unique_rooms, cast(sum(qty_on_hand) as bigint) as total_qty,
       count(*) filter (where package_barcode is not null and trim(package_barcode) <> ''
                        and lower(trim(package_barcode)) <> 'nan') as velocity_entries_count
from inventory""", "work", extra=[("mu", MU_SQL)]))
def q_import_summary(spark, sf_dir):
    from stockspark.plans.restock_queries import move_up_result
    return hs.import_summary(fx.inventory(spark, sf_dir), move_up_result(spark, sf_dir))


@register("retain_snapshots", with_views(f"""
select * from snapshot_entry
where snapshot_date >= (select max(snapshot_date) from snapshot_entry) - {RETAIN_DAYS}""", "snapshot_entry"))
def q_retain_snapshots(spark, sf_dir):
    h = _hist(spark, sf_dir)
    cutoff = F.date_sub(h.select(F.max("snapshot_date")).scalar(), RETAIN_DAYS)
    return hs.retain_snapshots(h, cutoff)


@register("snapshot_explode", with_views("select snapshot_date, entry_idx, barcode, room, qty from snapshot_entry",
                                         "snapshot_entry"))
def q_snapshot_explode(spark, sf_dir):
    """S5 round trip: the history written in the nested JSON shape (bounded
    chunks) into the shared folder, read back and flattened."""
    path = scratch_path(spark, "snapshot-json")
    hio.write_snapshot_json(_hist(spark, sf_dir), path)
    flat = hio.read_snapshot_json(spark, path)
    return flat.select("snapshot_date", "entry_idx", "barcode", "room", "qty")


@register("snapshot_store", "with import_entry as (" + IMPORT_ENTRY + """)
select store, import_id, snapshot_ts, snapshot_date, entry_idx, barcode, room, qty from import_entry""")
def q_snapshot_store(spark, sf_dir):
    """Two stores with two imports a day, appended store by store and one
    of them replayed: every import stays, none is doubled."""
    path = scratch_path(spark, "snapshots")
    h = fx.import_entry(spark, sf_dir)
    for store in (fx.STORE_A, fx.STORE_B, fx.STORE_A):
        hio.append_snapshots(h.where(F.col("store") == store), path)
    return hio.read_snapshots(spark, path).select(
        "store", F.col("import_id").cast("string").alias("import_id"), "snapshot_ts", "snapshot_date", "entry_idx",
        "barcode", "room", "qty")


@register("import_log", _isql("select * exclude (timestamp) from log"))
def q_import_log(spark, sf_dir):
    """Import-log rows appended to the shared folder twice (a replay) and read back."""
    path = scratch_path(spark, "import-log")
    log = _written(_log(spark, sf_dir), "import-log-rows")
    for _ in range(2):
        hio.append_import_log(log, path)
    return import_log_columns(hio.read_import_log(spark, path, "import_id")).drop("timestamp")


@register("retention_default", _isql("""
select store, import_id, import_ts, package_barcode, room, qty_on_hand from imports
where import_ts >= (select max(import_ts) from imports) - interval 90 days"""))
def q_retention_default(spark, sf_dir):
    """T4: the default of 90 days, counted back from the newest of the yearly imports."""
    h = fx.import_inventory(spark, sf_dir).select("store", "import_id", "import_ts", "package_barcode", "room",
                                                  "qty_on_hand")
    last = h.select(F.max("import_ts")).first()[0]
    return hs.purge_older_than(h, hs.DEFAULT_RETENTION_DAYS, last, "import_ts")


@register("retention_removed", with_views(f"""
select cast(count(distinct snapshot_date) filter (
         where snapshot_date < (select max(snapshot_date) from snapshot_entry) - {RETAIN_DAYS}) as bigint)
       as removed
from snapshot_entry""", "snapshot_entry"))
def q_retention_removed(spark, sf_dir):
    """T4: number of snapshots a retention purge removes."""
    h = _hist(spark, sf_dir)
    cutoff = F.date_sub(h.select(F.max("snapshot_date")).scalar(), RETAIN_DAYS)
    return hs.purged_count(h, hs.retain_snapshots(h, cutoff))


@register("purge_store", "with import_entry as (" + IMPORT_ENTRY + f"""), kept as (
select * from import_entry where snapshot_date >= (select max(snapshot_date) from import_entry) - {RETAIN_DAYS})
select store, import_id, snapshot_ts, snapshot_date, entry_idx, barcode, room, qty from kept""")
def q_purge_store(spark, sf_dir):
    """T4 on storage: expired days dropped from the stored history, the small files of the others merged, both twice."""
    path = scratch_path(spark, "retained")
    h = fx.import_entry(spark, sf_dir)
    hio.append_snapshots(h.repartition(4), path)
    as_of = h.select(F.max("snapshot_date").alias("d")).first().d
    for _ in range(2):
        rt.purge_store(spark, path, RETAIN_DAYS, as_of)
        rt.merge_store(spark, path)
    return hio.read_snapshots(spark, path).select("store", "import_id", "snapshot_ts", "snapshot_date", "entry_idx",
                                                  "barcode", "room", "qty")
