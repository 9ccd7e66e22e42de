"""Registered queries: move-up pipeline, cleaning and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.functions.rooms import alias_room, alias_room_with_defaults
from stockspark.operators import restock as mu
from stockspark.plans.registry import register
from stockspark.plans.views import FLOOR_LIST, room_alias_sql, sql_list, with_views
from stockspark.schema import DEFAULT_ROOM_ALIASES

# ---- fixed values: fixture parameters
CANDIDATE_ROOMS = ["Incoming Deliveries", "Backstock"]
BRAND_SELECTION = ["Brand#11", "Brand#22", "Brand#33", "Brand#44"]
TYPE_SELECTION = ["ECONOMY", "PROMO", "STANDARD"]

OUT_COLS = ["type", "brand", "product_name", "package_barcode", "room", "qty_on_hand",
            "distributor", "store", "size", "received_date", "wholesale_cost", "unit_price",
            "expiration_date"]
OUT_SQL = ", ".join(OUT_COLS)


def _inv(spark, sf_dir):
    return fx.inventory(spark, sf_dir)


def move_up_result(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return mu.move_up(inv, CANDIDATE_ROOMS, aliases=fx.ROOM_ALIASES)


MU_SQL = f"""
select {OUT_SQL} from work c
where trim(room) in ({sql_list(CANDIDATE_ROOMS)})
  and not exists (select 1 from work f
                  where lower(trim(f.room)) in ({FLOOR_LIST})
                    and f.brand = c.brand and f.product_name = c.product_name)
"""


@register("move_up", with_views(MU_SQL, "work"))
def q_move_up(spark, sf_dir):
    return move_up_result(spark, sf_dir).select(*OUT_COLS)


@register("move_up_by_store", with_views(f"""
select {OUT_SQL} from work c
where trim(room) in ({sql_list(CANDIDATE_ROOMS)})
  and not exists (select 1 from work f
                  where lower(trim(f.room)) in ({FLOOR_LIST}) and f.store = c.store
                    and f.brand = c.brand and f.product_name = c.product_name)
""", "work"))
def q_move_up_by_store(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return mu.move_up(inv, CANDIDATE_ROOMS, aliases=fx.ROOM_ALIASES, keys=("store",)).select(*OUT_COLS)


@register("move_up_diag", with_views(f"""
select count(*) as total_loaded,
       count(*) filter (where product_name is not null and brand is not null
                        and package_barcode is not null and room is not null) as after_dropna,
       count(*) filter (where product_name is not null and brand is not null
                        and package_barcode is not null and room is not null) as after_brand,
       count(*) filter (where product_name is not null and brand is not null
                        and package_barcode is not null and room is not null) as after_type_filter,
       (select count(*) from work) as after_type,
       (select count(*) from work where trim(room) in ({sql_list(CANDIDATE_ROOMS)})) as candidate_pool,
       (select count(*) from work c where trim(room) in ({sql_list(CANDIDATE_ROOMS)})
          and exists (select 1 from work f where lower(trim(f.room)) in ({FLOOR_LIST})
                      and f.brand = c.brand and f.product_name = c.product_name)) as removed_as_on_sf,
       (select count(*) from work c where trim(room) in ({sql_list(CANDIDATE_ROOMS)})
          and not exists (select 1 from work f where lower(trim(f.room)) in ({FLOOR_LIST})
                      and f.brand = c.brand and f.product_name = c.product_name)) as move_up
from inventory
""", "work"))
def q_move_up_diag(spark, sf_dir):
    return mu.move_up_diag(_inv(spark, sf_dir), CANDIDATE_ROOMS, aliases=fx.ROOM_ALIASES)


_SPLIT_EXTRA = ["distributor", "store", "size", "received_date", "wholesale_cost",
                "unit_price", "expiration_date"]
_ORD = "ord_1, ord_2, ord_3, ord_4, ord_5, ord_6"


def _split_sql(source: str) -> str:
    firsts = ",\n       ".join(
        f"first({c} order by {_ORD}) filter (where {c} is not null) as {c}" for c in _SPLIT_EXTRA)
    return f"""
select package_barcode, room, type, brand, product_name,
       cast(sum(qty_on_hand) as bigint) as qty_on_hand,
       {firsts}
from (select trim(coalesce(package_barcode, '')) as package_barcode,
             trim(coalesce(room, '')) as room, trim(coalesce(type, '')) as type,
             trim(coalesce(brand, '')) as brand, trim(coalesce(product_name, '')) as product_name,
             qty_on_hand, {", ".join(_SPLIT_EXTRA)}, {_ORD}
      from {source}) t
where package_barcode <> ''
group by package_barcode, room, type, brand, product_name
"""


@register("split_packages", with_views(_split_sql("inventory"), "inventory"))
def q_split_packages(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return mu.split_packages(inv, fx.ord_key(), extra=_SPLIT_EXTRA)


@register("move_up_merged", with_views(_split_sql("mu"), "work", extra=[("mu", f"""
select * from work c
where trim(room) in ({sql_list(CANDIDATE_ROOMS)})
  and not exists (select 1 from work f where lower(trim(f.room)) in ({FLOOR_LIST})
                  and f.brand = c.brand and f.product_name = c.product_name)""")]))
def q_move_up_merged(spark, sf_dir):
    """The full move-up list: anti join, then split-package merge, backstock first."""
    return mu.split_packages(move_up_result(spark, sf_dir), fx.ord_key(), extra=_SPLIT_EXTRA)


@register("drop_incomplete", with_views(f"""
select {OUT_SQL} from inventory where ord_3 % 29 <> 0
""", "inventory"))
def q_drop_incomplete(spark, sf_dir):
    """F1 on raw imports, where some rows lack a brand."""
    return mu.drop_incomplete(fx.import_inventory(spark, sf_dir)).select(*OUT_COLS)


@register("filter_brand_type", with_views(f"""
select {OUT_SQL} from inventory
where brand in ({sql_list(BRAND_SELECTION)}) and type in ({sql_list(TYPE_SELECTION)})
""", "inventory"))
def q_filter_brand_type(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return mu.filter_in(mu.filter_in(inv, "brand", BRAND_SELECTION), "type",
                        TYPE_SELECTION).select(*OUT_COLS)


@register("exclude_accessories", with_views(f"""
select {OUT_SQL} from inventory where not coalesce(lower(type) like '%accessor%', false)
""", "inventory"))
def q_exclude_accessories(spark, sf_dir):
    return mu.exclude_accessories(_inv(spark, sf_dir)).select(*OUT_COLS)


@register("sales_floor_items", with_views(f"""
select {OUT_SQL} from work where lower(trim(room)) in ({FLOOR_LIST})
""", "work"))
def q_sales_floor_items(spark, sf_dir):
    return mu.sales_floor_items(mu.prepare(_inv(spark, sf_dir), fx.ROOM_ALIASES)).select(*OUT_COLS)


@register("candidate_items", with_views(f"""
select {OUT_SQL} from work where trim(room) in ({sql_list(CANDIDATE_ROOMS)})
""", "work"))
def q_candidate_items(spark, sf_dir):
    return mu.candidate_items(mu.prepare(_inv(spark, sf_dir), fx.ROOM_ALIASES),
                              CANDIDATE_ROOMS).select(*OUT_COLS)


@register("normalize_rooms", with_views(f"""
select package_barcode, room as raw_room, {room_alias_sql()} as room from inventory
""", "inventory"))
def q_normalize_rooms(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return inv.select("package_barcode", F.col("room").alias("raw_room"),
                      alias_room(F.col("room"), fx.ROOM_ALIASES).alias("room"))


_DEFAULTS_PLUS_USER = {**{k.lower(): v for k, v in DEFAULT_ROOM_ALIASES.items()},
                       **{k.lower(): v for k, v in fx.ROOM_ALIASES.items()}}


@register("normalize_rooms_default", with_views(f"""
select package_barcode, room as raw_room, {room_alias_sql(aliases=_DEFAULTS_PLUS_USER)} as room
from inventory
""", "inventory"))
def q_normalize_rooms_default(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return inv.select("package_barcode", F.col("room").alias("raw_room"),
                      alias_room_with_defaults(F.col("room"), fx.ROOM_ALIASES).alias("room"))


@register("backstock_sort", with_views(f"""
select {OUT_SQL}, row_number() over (order by case when lower(trim(room)) = 'backstock' then 0 else 1 end,
       type, brand, product_name, {_ORD}) as pos
from inventory
""", "inventory"))
def q_backstock_sort(spark, sf_dir):
    """O1 over the whole table; ``pos`` numbers the sorted rows without a
    single-partition window (see operators.listing.number_rows)."""
    from stockspark.operators.listing import number_rows
    inv = _inv(spark, sf_dir)
    return number_rows(inv, [mu.backstock_first(F.col("room")), "type", "brand", "product_name",
                             *fx.ORD_COLS], "pos").select(*OUT_COLS, "pos")
