"""Registered queries: user state, selections, search, display text, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.functions import text as tx
from stockspark.operators import listing as ls
from stockspark.operators import search as se
from stockspark.operators import state as st
from stockspark.operators import velocity as vl
from stockspark.plans.restock_queries import MU_SQL, OUT_COLS, OUT_SQL, move_up_result
from stockspark.plans.registry import register
from stockspark.plans.velocity_queries import _HB, _VEL, T
from stockspark.plans.views import room_alias_sql, sql_list, with_views
from stockspark.schema import SALES_FLOOR_ALIASES
from stockspark.session import scratch_path

# ---- fixed values: fixture parameters (user selections)
DISTRIBUTORS = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000003"]
SAVED_ROOMS = ["Backstock", "Garage", "Vault"]
SAVED_BRANDS = ["Brand#11", "Brand#99"]
SAVED_TYPES: list[str] = []
AUDIT_TYPES = ["PROMO", "STANDARD"]
AUDIT_ROOMS = ["Backstock", "Vault", "Sales Floor"]
HIDDEN_ROOMS = ["Overflow", "Sample Vault"]
TOKEN_QUERY = "Red ROD promo"
REGEX_QUERY = "blue (rod|widget) #1[0-9]{2}-"
LITERAL_QUERY = "small widget #1"

_STATE = [("excl", "select distinct trim(package_barcode) as barcode from inventory "
                   "where room = 'Backstock' and qty_on_hand <= 2"),
          ("prio", "select distinct trim(package_barcode) as barcode from inventory where qty_on_hand >= 48")]


def _sql(body: str, *names: str, extra=()) -> str:
    return with_views(body, "inventory", *names, extra=[*_STATE, *extra])


def _inv(spark, sf_dir):
    return fx.inventory(spark, sf_dir)


@register("hide_excluded", _sql(f"select {OUT_SQL} from inventory where trim(package_barcode) not in (select barcode from excl)"))
def q_hide_excluded(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return st.hide_excluded(inv, fx.excluded_barcodes(inv)).select(*OUT_COLS)


@register("priority_items", _sql(f"select {OUT_SQL} from inventory where trim(package_barcode) in (select barcode from prio)"))
def q_priority_items(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return st.rows_in_set(inv, fx.priority_barcodes(inv)).select(*OUT_COLS).orderBy("room", "brand", "product_name")


@register("excluded_items", _sql(f"select {OUT_SQL} from inventory where trim(package_barcode) in (select barcode from excl)"))
def q_excluded_items(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return st.rows_in_set(inv, fx.excluded_barcodes(inv)).select(*OUT_COLS).orderBy("room", "brand", "product_name")


@register("prune_state", _sql("select barcode from excl where barcode in "
                              "(select trim(package_barcode) from inventory where store = 'A')"))
def q_prune_state(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return st.prune_state(fx.excluded_barcodes(inv), inv.where(F.col("store") == "A"))


@register("export_rows", _sql(f"select * from mu where trim(package_barcode) not in (select barcode from prio)",
                              "work", extra=[("mu", MU_SQL)]))
def q_export_rows(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return st.export_rows(move_up_result(spark, sf_dir).select(*OUT_COLS), fx.priority_barcodes(inv))


@register("brands_for_distributors", _sql(f"""
select distinct trim(brand) as brand from inventory
where (case when trim(coalesce(distributor, '')) = '' then 'Unknown Distributor' else trim(distributor) end)
      in ({sql_list(DISTRIBUTORS)}) and brand is not null and trim(brand) <> ''"""))
def q_brands_for_distributors(spark, sf_dir):
    return st.brands_for_distributors(_inv(spark, sf_dir), DISTRIBUTORS)


@register("toggle_set", _sql("""
select coalesce(e.barcode, p.barcode) as barcode from excl e full outer join prio p on e.barcode = p.barcode
where e.barcode is null or p.barcode is null"""))
def q_toggle_set(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return st.toggle_set(fx.excluded_barcodes(inv), fx.priority_barcodes(inv))


@register("list_rooms", _sql(f"select distinct {room_alias_sql()} as room from inventory where room is not null"))
def q_list_rooms(spark, sf_dir):
    return st.list_values(_inv(spark, sf_dir), "room", fx.ROOM_ALIASES)


@register("list_brands", _sql("select distinct trim(brand) as brand from inventory where brand is not null and trim(brand) <> ''"))
def q_list_brands(spark, sf_dir):
    return st.list_values(_inv(spark, sf_dir), "brand")


@register("list_types", _sql("select distinct trim(type) as type from inventory where type is not null and trim(type) <> ''"))
def q_list_types(spark, sf_dir):
    return st.list_values(_inv(spark, sf_dir), "type")


_FLOOR_ALL = sql_list([*SALES_FLOOR_ALIASES, "sales floor"])
_ROOMS = f"select distinct {room_alias_sql()} as room from inventory where room is not null"
_DEFAULT_ROOMS = f"""
select * from (
  select 0 as pos, max(room) filter (where lower(trim(room)) = 'incoming deliveries') as room from rooms
  union all
  select 1, max(room) filter (where lower(trim(room)) = 'backstock') from rooms) t
where (select count(*) filter (where lower(trim(room)) in ('incoming deliveries', 'backstock')) from
       (select distinct lower(trim(room)) as room from rooms) u) = 2
union all
select cast(row_number() over (order by room) - 1 as integer), room from rooms
where lower(trim(room)) not in ({_FLOOR_ALL})
  and (select count(*) from (select distinct lower(trim(room)) as room from rooms) u
       where room in ('incoming deliveries', 'backstock')) < 2"""


@register("default_rooms", _sql(_DEFAULT_ROOMS, extra=[("rooms", _ROOMS)]))
def q_default_rooms(spark, sf_dir):
    return st.default_rooms(_inv(spark, sf_dir), fx.ROOM_ALIASES)


@register("effective_filters", _sql(f"""
select 'rooms' as filter, room as value from rooms where room in ({sql_list(SAVED_ROOMS)})
union all
select 'brands', b from (select distinct trim(brand) as b from inventory where brand is not null) x
where b in ({sql_list(SAVED_BRANDS)})
union all
select 'types', 'ALL'"""
                                     if SAVED_TYPES == [] else None, extra=[("rooms", _ROOMS)]))
def q_effective_filters(spark, sf_dir):
    return st.effective_filters(_inv(spark, sf_dir), SAVED_ROOMS, SAVED_BRANDS, SAVED_TYPES, fx.ROOM_ALIASES)


@register("row_status", _sql("""
select trim(i.package_barcode) as package_barcode, i.room,
       case when trim(i.package_barcode) in (select barcode from prio) then 'priority'
            when lower(trim(i.room)) = 'backstock' then 'backstock'
            when trim(i.package_barcode) in (select barcode from excl) and trim(i.package_barcode) <> '' then 'excluded'
            when coalesce(v.velocity_label, 'New') in ('Slow', 'Stale') then 'slow'
            when coalesce(v.velocity_label, 'New') = 'Fast' then 'fast' else 'normal' end as row_status
from inventory i left join vel v on trim(i.package_barcode) = v.barcode""",
                             "current_items", extra=[("hb", _HB), ("vel", _VEL)]))
def q_row_status(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    h = fx.snapshot_entry(spark, sf_dir)
    vel = vl.velocity_metrics(fx.current_items(spark, sf_dir, h), h, fx.VELOCITY_AS_OF, T)
    out = st.row_status(inv, fx.priority_barcodes(inv), fx.excluded_barcodes(inv), vel)
    return out.select(F.trim("package_barcode").alias("package_barcode"), "room", "row_status")


@register("audit_selection", _sql(f"""
select * from (
  select type, brand, product_name, package_barcode, {room_alias_sql()} as room, qty_on_hand,
         case when trim(coalesce(distributor, '')) = '' then 'Unknown Distributor' else trim(distributor) end
           as distributor
  from inventory) t
where type in ({sql_list(AUDIT_TYPES)}) and room in ({sql_list(AUDIT_ROOMS)})"""))
def q_audit_selection(spark, sf_dir):
    out = st.audit_selection(_inv(spark, sf_dir), types=AUDIT_TYPES, rooms=AUDIT_ROOMS, aliases=fx.ROOM_ALIASES)
    return out.select("type", "brand", "product_name", "package_barcode", "room", "qty_on_hand", "distributor")


@register("accessory_audit", _sql(f"select {OUT_SQL} from inventory where coalesce(lower(type) like '%accessor%', false)"))
def q_accessory_audit(spark, sf_dir):
    return st.accessory_audit(_inv(spark, sf_dir)).select(*OUT_COLS)


@register("hide_rooms", _sql(f"select {OUT_SQL} from inventory where not coalesce(trim(room) in ({sql_list(HIDDEN_ROOMS)}), false)"))
def q_hide_rooms(spark, sf_dir):
    return st.hide_rooms(_inv(spark, sf_dir), HIDDEN_ROOMS).select(*OUT_COLS)


_TYPE7 = "case when length(type) <= 7 then type else left(type, 4) || '...' end"
_TOKENS = " and ".join(f"contains(hay, '{t}')" for t in TOKEN_QUERY.lower().split())


@register("search_all_tokens", _sql(f"""
select {OUT_SQL} from (
  select *, lower(concat_ws(' ', {_TYPE7}, brand, product_name, package_barcode, room,
                           cast(qty_on_hand as varchar))) as hay from inventory) t
where {_TOKENS}"""))
def q_search_all_tokens(spark, sf_dir):
    return se.search_all_tokens(_inv(spark, sf_dir), TOKEN_QUERY).select(*OUT_COLS)


_HAY = "lower(concat_ws(' | ', type, brand, product_name, room))"


@register("search_text", _sql(f"select {OUT_SQL} from inventory where regexp_matches({_HAY}, '{REGEX_QUERY}')"))
def q_search_text(spark, sf_dir):
    return se.search_text(_inv(spark, sf_dir), REGEX_QUERY, ["type", "brand", "product_name", "room"],
                          regex=True).select(*OUT_COLS)


@register("search_literal", _sql(f"select {OUT_SQL} from inventory where contains({_HAY}, '{LITERAL_QUERY}')"))
def q_search_literal(spark, sf_dir):
    return se.search_text(_inv(spark, sf_dir), LITERAL_QUERY, ["type", "brand", "product_name", "room"]
                          ).select(*OUT_COLS)


_DIG = "regexp_replace(trim(package_barcode), '[^0-9]+', '', 'g')"


@register("barcode_tail", _sql(f"""
select package_barcode, right(trim(package_barcode), 6) as tail6,
       case when length({_DIG}) > 0 then right({_DIG}, 6) else right(trim(package_barcode), 6) end as metrc6,
       right(trim(package_barcode), 8) as tail8
from inventory"""))
def q_barcode_tail(spark, sf_dir):
    c = F.col("package_barcode")
    return _inv(spark, sf_dir).select("package_barcode", tx.barcode_tail(c, 6).alias("tail6"),
                                      tx.barcode_tail(c, 6, True).alias("metrc6"),
                                      tx.barcode_tail(c, 8).alias("tail8"))


@register("truncate_cols", _sql("""
select package_barcode,
       case when length(product_name) <= 18 then product_name else left(product_name, 17) || '…' end as product_18,
       case when length(type) <= 7 then type else left(type, 4) || '...' end as type_7,
       case when length(product_name) <= 12 then product_name else left(product_name, 9) || '...' end as product_12,
       case when length(type) <= 5 then type else left(type, 5) || '…' end as type_audit
from inventory"""))
def q_truncate_cols(spark, sf_dir):
    return _inv(spark, sf_dir).select(
        "package_barcode", tx.truncate_text(F.col("product_name"), 18).alias("product_18"),
        tx.ellipses(F.col("type"), 7).alias("type_7"), tx.ellipses(F.col("product_name"), 12).alias("product_12"),
        tx.truncate_plain(F.col("type"), 5).alias("type_audit"))


@register("format_currency", _sql("""
select package_barcode, '$' || format('{:,.2f}', unit_price) as unit_price_text,
       '$' || format('{:,.2f}', unit_price * qty_on_hand * 100) as stock_value_text
from inventory"""))
def q_format_currency(spark, sf_dir):
    return _inv(spark, sf_dir).select(
        "package_barcode", tx.format_currency(F.col("unit_price")).alias("unit_price_text"),
        tx.format_currency(F.col("unit_price") * F.col("qty_on_hand") * 100).alias("stock_value_text"))


@register("item_label", _sql("""
select package_barcode, brand || ' | ' || product_name || ' | ' || room || ' | Qty:' || cast(qty_on_hand as varchar)
       || ' | …' || right(package_barcode, 6) as label
from inventory"""))
def q_item_label(spark, sf_dir):
    c = F.col
    return _inv(spark, sf_dir).select(
        "package_barcode", tx.item_label(c("brand"), c("product_name"), c("room"), c("qty_on_hand"),
                                         c("package_barcode")).alias("label"))


_ORD = "ord_1, ord_2, ord_3, ord_4, ord_5, ord_6"
_AUD = f"""
select *, row_number() over (order by distributor, type, size_full, product_name, {_ORD}) as item_no,
       row_number() over (partition by distributor order by type, size_full, product_name, {_ORD}) as group_row
from (select * replace (case when trim(coalesce(distributor, '')) = '' then 'Unknown Distributor'
                             else trim(distributor) end as distributor,
                        case when trim(coalesce(room, '')) = '' then 'Sales Floor' else trim(room) end as room,
                        case when trim(coalesce(store, '')) = '' then 'Store' else trim(store) end as store),
             trim(coalesce(size, '')) as size_full
      from inventory) t"""
_AUDG = """
select distributor, count(*) as n, min(item_no) as first_item,
       coalesce(sum(ceil(count(*) / 35)) over (order by min(item_no)
                rows between unbounded preceding and 1 preceding), 0) + 1 as first_page
from aud group by distributor"""
_AUDL = """
select a.distributor as "group", a.item_no, cast(g.first_page + floor((a.group_row - 1) / 35) as bigint) as page,
       case when length(a.type) <= 7 then a.type else left(a.type, 7) || '…' end as type_disp,
       case when length(a.product_name) <= 75 then a.product_name else left(a.product_name, 72) || '...' end
         as product_disp,
       right(trim(a.package_barcode), 8) as metrc_tail, a.qty_on_hand as qty, a.distributor, a.brand, a.type,
       a.store, a.room
from aud a join audg g using (distributor)"""


def _audit(spark, sf_dir):
    return ls.audit_listing(_inv(spark, sf_dir), fx.ord_key(), "distributor_type_size_product")


@register("audit_listing", _sql("select * from audl", extra=[("aud", _AUD), ("audg", _AUDG), ("audl", _AUDL)]))
def q_audit_listing(spark, sf_dir):
    return _audit(spark, sf_dir)


@register("audit_index", _sql("""
select "group", case when min(item_no) = max(item_no) then cast(min(item_no) as varchar)
                     else min(item_no) || '-' || max(item_no) end as items,
       count(*) as count,
       case when min(page) = max(page) then cast(min(page) as varchar) else min(page) || '-' || max(page) end as pages,
       min(item_no) as first_item
from audl group by "group" """, extra=[("aud", _AUD), ("audg", _AUDG), ("audl", _AUDL)]))
def q_audit_index(spark, sf_dir):
    return ls.audit_index(_audit(spark, sf_dir))


_STK = f"""
select item_no, cast(floor((item_no - 1) / 30) + 1 as bigint) as page,
       case when length(type) <= 7 then type else left(type, 4) || '...' end as type,
       case when length(pn) <= 75 then pn else left(pn, 72) || '...' end as product_name,
       right(trim(package_barcode), 6) as barcode_tail,
       case when length(room) <= 12 then room else left(room, 9) || '...' end as room,
       qty_on_hand as qty, rnk as block
from (select *, row_number() over (order by rnk, k1, k2, k3, {_ORD}) as item_no from (
        select type, '⭐ ' || product_name as pn, package_barcode, room, qty_on_hand, 0 as rnk,
               room as k1, brand as k2, product_name as k3, {_ORD}
        from inventory where trim(package_barcode) in (select barcode from prio)
        union all
        select type, product_name, package_barcode, room, qty_on_hand,
               case when lower(trim(room)) = 'backstock' then 1 else 2 end, type, brand, product_name, {_ORD}
        from mu where trim(package_barcode) not in (select barcode from prio)) u) v"""


@register("sticker_listing", _sql(_STK, "work", extra=[("mu", MU_SQL.replace("select " + OUT_SQL, "select *"))]))
def q_sticker_listing(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    prio_rows = st.rows_in_set(inv, fx.priority_barcodes(inv))
    return ls.sticker_listing(move_up_result(spark, sf_dir), prio_rows, fx.ord_key())


_NUM = "try_cast(replace(trim(size), ',', '') as double)"


@register("smart_sort", _sql(f"""
select 'numeric' as variant, package_barcode, row_number() over (
         order by {_NUM} asc nulls last, lower(trim(size)), {_ORD}) as pos from inventory
union all
select 'text_desc', package_barcode, row_number() over (order by lower(trim(brand)) desc, {_ORD}) from inventory
union all
select 'group_all_numeric', package_barcode, row_number() over (
         order by type, {_NUM} desc nulls last, lower(trim(size)) desc, {_ORD}) from inventory"""))
def q_smart_sort(spark, sf_dir):
    # each variant samples and sorts the rows: the tables are joined for them once
    path = scratch_path(spark, "sort-rows")
    rows = _inv(spark, sf_dir).select("package_barcode", "size", "brand", "type", *fx.ORD_COLS)
    rows.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    variants = {"numeric": ls.smart_sort_keys(rows, "size"),
                "text_desc": ls.smart_sort_keys(rows, "brand", descending=True),
                "group_all_numeric": ls.smart_sort_keys(rows, "size", True, "type", all_numeric=True)}
    out = [ls.number_rows(rows, [*keys, *fx.ORD_COLS], "pos").select(F.lit(v).alias("variant"), "package_barcode", "pos")
           for v, keys in variants.items()]
    return reduce(DataFrame.unionByName, out)


# ------------------------------------------------------------------ display + sinks

@register("display_velocity", with_views("""
select v.barcode, v.velocity_label, v.sell_rate, v.qty_delta, v.room_changes, v.stock_age_days,
       v.qty_unchanged_streak, v.velocity_score,
       v.velocity_label as "Status", v.sell_rate as "Sells/Day", v.qty_delta as "Qty Change",
       v.room_changes as "Room Moves", v.stock_age_days as "Age (Days)",
       v.qty_unchanged_streak as "Unchanged Imports", v.velocity_score as "Score"
from vel v""", "current_items", extra=[("hb", _HB), ("vel", _VEL)]))
def q_display_velocity(spark, sf_dir):
    """Velocity rows with their friendly column names."""
    from stockspark.operators.display import display_projection, with_friendly_names
    h = fx.snapshot_entry(spark, sf_dir)
    vel = vl.velocity_metrics(fx.current_items(spark, sf_dir, h), h, fx.VELOCITY_AS_OF, T)
    shown = display_projection(vel, ["barcode", "velocity_label"],
                               ["sell_rate", "qty_delta", "room_changes", "stock_age_days",
                                "qty_unchanged_streak", "velocity_score", "received_date"])
    return with_friendly_names(shown)


@register("csv_export", _sql(f"select {OUT_SQL} from inventory where trim(package_barcode) in (select barcode from prio)"))
def q_csv_export(spark, sf_dir):
    """The priority list written as CSV (listed columns, header) to the
    shared folder and read back with its schema."""
    from stockspark.sources.history_io import write_csv
    inv = _inv(spark, sf_dir)
    rows = st.rows_in_set(inv, fx.priority_barcodes(inv)).select(*OUT_COLS)
    path = scratch_path(spark, "csv-export")
    write_csv(rows, path, OUT_COLS)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@register("report_export", _sql(f"""
select 'priority' as sheet, count(*) as rows_written from inventory
where trim(package_barcode) in (select barcode from prio)
union all
select 'move_up', count(*) from mu where trim(package_barcode) not in (select barcode from prio)""",
                                "work", extra=[("mu", MU_SQL)]))
def q_report_export(spark, sf_dir):
    """A multi-result report (one folder per named result) and the rows
    each result holds when read back."""
    from stockspark.sources.history_io import write_report
    inv = _inv(spark, sf_dir)
    prio = fx.priority_barcodes(inv)
    results = {"priority": st.rows_in_set(inv, prio).select(*OUT_COLS),
               "move_up": st.export_rows(move_up_result(spark, sf_dir).select(*OUT_COLS), prio)}
    path = scratch_path(spark, "report")
    write_report(results, path)
    parts = [spark.read.parquet(f"{path}/{n}").select(F.lit(n).alias("sheet")) for n in results]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("sheet").agg(F.count(F.lit(1)).alias("rows_written"))
