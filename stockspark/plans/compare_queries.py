"""Registered queries: product maps and the two-store comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.operators import compare as cp
from stockspark.plans.registry import register
from stockspark.plans.views import with_views

A, B = fx.STORE_A, fx.STORE_B

_BASE = """
select store, trim(coalesce(brand, '')) as brand, trim(coalesce(product_name, '')) as product_name,
       trim(coalesce(type, '')) as type, trim(coalesce(room, '')) as room, qty_on_hand as qty,
       row_number() over (order by ord_1, ord_2, ord_3, ord_4, ord_5, ord_6) as rn
from inventory"""
_PM = """
select t.store, t.brand, t.product_name, t.type, r.rooms, t.qty
from (select store, brand, product_name, arg_min(type, rn) as type, cast(sum(qty) as bigint) as qty
      from pm_base group by store, brand, product_name) t
join (select store, brand, product_name,
             list_reduce(list(room order by first_rn),
                         lambda acc, x: case when x <> '' and not contains(acc, x)
                                             then acc || ', ' || x else acc end) as rooms
      from (select store, brand, product_name, room, min(rn) as first_rn
            from pm_base group by store, brand, product_name, room) pr
      group by store, brand, product_name) r
using (store, brand, product_name)"""
_CMP = f"""
select coalesce(a.brand, b.brand) as brand, coalesce(a.product_name, b.product_name) as product_name,
       a.type as type_a, a.rooms as rooms_a, a.qty as qty_a,
       b.type as type_b, b.rooms as rooms_b, b.qty as qty_b
from (select * from pm where store = '{A}') a
full outer join (select * from pm where store = '{B}') b
  on a.brand = b.brand and a.product_name = b.product_name"""

_RATIO = "greatest(qty_a, qty_b) / greatest(least(qty_a, qty_b), 1)"
_IMB = f"""
select type_a as type, brand, product_name, qty_a, qty_b,
       printf('%.1fx', {_RATIO}) as ratio,
       case when qty_a > qty_b then '{A}' else '{B}' end as overstocked
from cmp
where qty_a is not null and qty_b is not null and not (qty_a = 0 and qty_b = 0)
  and {_RATIO} >= 2.0 and abs(qty_a - qty_b) >= 3"""
_RECS = f"""
select case when qty_a is null or qty_b is null
            then case when coalesce(qty_a, qty_b) >= 3 then 'High' else 'Medium' end
            when {_RATIO} >= 3.0 and abs(qty_a - qty_b) >= 5 then 'Medium' else 'Low' end as priority,
       coalesce(type_a, type_b) as type, brand, product_name,
       case when qty_b is null then '{A}' when qty_a is null then '{B}'
            when qty_a > qty_b then '{A}' else '{B}' end as from_store,
       case when qty_b is null then '{B}' when qty_a is null then '{A}'
            when qty_a > qty_b then '{B}' else '{A}' end as to_store,
       cast(case when qty_a is null or qty_b is null then coalesce(qty_a, qty_b)
                 else abs(qty_a - qty_b) // 2 end as bigint) as qty,
       case when qty_b is null then 'Not at {B}' when qty_a is null then 'Not at {A}'
            else 'Imbalanced (' || printf('%.1f', {_RATIO}) || 'x)' end as reason,
       case when qty_a is null or qty_b is null
            then case when coalesce(qty_a, qty_b) >= 3 then 0 else 1 end
            when {_RATIO} >= 3.0 and abs(qty_a - qty_b) >= 5 then 1 else 2 end as sort_rank,
       cast(case when qty_a is null or qty_b is null then coalesce(qty_a, qty_b)
                 else abs(qty_a - qty_b) end as bigint) as sort_units
from cmp
where (qty_b is null and qty_a > 0) or (qty_a is null and qty_b > 0)
   or (qty_a is not null and qty_b is not null and not (qty_a = 0 and qty_b = 0)
       and {_RATIO} >= 2.0 and abs(qty_a - qty_b) >= 3)"""


def _sql(body: str, *extra: tuple[str, str]) -> str:
    return with_views(body, "inventory", extra=[("pm_base", _BASE), ("pm", _PM), ("cmp", _CMP),
                                                ("imb", _IMB), ("recs", _RECS), *extra])


def _pm(spark, sf_dir):
    return cp.product_map(fx.inventory(spark, sf_dir), fx.ord_key())


def _cmp(spark, sf_dir):
    return cp.store_comparison(_pm(spark, sf_dir), A, B)


@register("product_map", _sql("select store, brand, product_name, type, rooms, qty from pm"))
def q_product_map(spark, sf_dir):
    return _pm(spark, sf_dir)


@register("only_a", _sql("select type_a as type, brand, product_name, rooms_a as rooms, qty_a as qty "
                         "from cmp where qty_a is not null and qty_b is null"))
def q_only_a(spark, sf_dir):
    return cp.only_in(_cmp(spark, sf_dir), "a")


@register("only_b", _sql("select type_b as type, brand, product_name, rooms_b as rooms, qty_b as qty "
                         "from cmp where qty_b is not null and qty_a is null"))
def q_only_b(spark, sf_dir):
    return cp.only_in(_cmp(spark, sf_dir), "b")


@register("both_stores", _sql("""
select type_a as type, brand, product_name, rooms_a, qty_a, rooms_b, qty_b, qty_a - qty_b as diff,
       abs(qty_a - qty_b) > greatest(qty_a, qty_b) * 0.5 and abs(qty_a - qty_b) >= 3 as imbalanced
from cmp where qty_a is not null and qty_b is not null"""))
def q_both_stores(spark, sf_dir):
    return cp.both_stores(_cmp(spark, sf_dir))


@register("imbalances", _sql("select * from imb"))
def q_imbalances(spark, sf_dir):
    return cp.sort_imbalances(cp.imbalances(_cmp(spark, sf_dir), A, B))


@register("transfer_recs", _sql("select * from recs"))
def q_transfer_recs(spark, sf_dir):
    return cp.transfer_recs(_cmp(spark, sf_dir), A, B).orderBy("sort_rank", F.col("sort_units").desc(),
                                                               "brand", "product_name")


@register("by_type", _sql("""
select store, type, count(*) as products, cast(sum(qty) as bigint) as units,
       sum(qty) / greatest(count(*), 1) as avg_qty
from pm group by store, type"""))
def q_by_type(spark, sf_dir):
    return cp.category_breakdown(_pm(spark, sf_dir), "type")


@register("by_brand", _sql("""
select store, brand, count(*) as products, cast(sum(qty) as bigint) as units,
       sum(qty) / greatest(count(*), 1) as avg_qty
from pm group by store, brand"""))
def q_by_brand(spark, sf_dir):
    return cp.category_breakdown(_pm(spark, sf_dir), "brand")


@register("store_overview", _sql("""
select store, count(*) as unique_products, cast(sum(qty) as bigint) as total_units,
       sum(qty) / count(*) as avg_units
from pm group by store"""))
def q_store_overview(spark, sf_dir):
    return cp.store_overview(_pm(spark, sf_dir))


@register("store_pair_overview", _sql("""
select count(qty_a) as products_a, count(qty_b) as products_b,
       cast(coalesce(sum(qty_a), 0) as bigint) as units_a, cast(coalesce(sum(qty_b), 0) as bigint) as units_b,
       count(*) filter (where qty_a is not null and qty_b is null) as exclusive_a,
       count(*) filter (where qty_b is not null and qty_a is null) as exclusive_b,
       count(*) filter (where qty_a is not null and qty_b is not null) as shared,
       count(*) filter (where qty_a is not null and qty_b is not null)
         / greatest(count(qty_a), count(qty_b), 1) * 100 as overlap_pct
from cmp"""))
def q_store_pair_overview(spark, sf_dir):
    return cp.store_pair_overview(_cmp(spark, sf_dir))


@register("room_distribution", _sql("""
select store, room, count(*) as products, cast(sum(qty) as bigint) as units
from (select store, qty, trim(unnest(string_split(rooms, ', '))) as room from pm) t
where room <> ''
group by store, room"""))
def q_room_distribution(spark, sf_dir):
    return cp.room_distribution(_pm(spark, sf_dir))


@register("brand_gap", _sql(f"""
select brand, qty_a, qty_b, total, qty_a - qty_b as gap,
       abs(qty_a - qty_b) > total * 0.4 and abs(qty_a - qty_b) >= 5 as flagged
from (select brand, cast(sum(qty) as bigint) as total,
             cast(coalesce(sum(qty) filter (where store = '{A}'), 0) as bigint) as qty_a,
             cast(coalesce(sum(qty) filter (where store = '{B}'), 0) as bigint) as qty_b
      from pm where store in ('{A}', '{B}') group by brand
      order by total desc, brand limit 15) t"""))
def q_brand_gap(spark, sf_dir):
    return cp.brand_gap(_pm(spark, sf_dir), A, B)


@register("exclusive_by_type", _sql(f"""
select case when qty_a is not null then '{A}' else '{B}' end as store,
       coalesce(type_a, type_b) as type, count(*) as products
from cmp where (qty_a is null) <> (qty_b is null) group by 1, 2"""))
def q_exclusive_by_type(spark, sf_dir):
    return cp.exclusive_by_type(_cmp(spark, sf_dir), A, B)


@register("imbalance_summary", _sql(f"""
select count(*) as imbalances, count(*) filter (where overstocked = '{A}') as overstocked_a,
       count(*) filter (where overstocked = '{B}') as overstocked_b from imb"""))
def q_imbalance_summary(spark, sf_dir):
    return cp.imbalance_summary(cp.imbalances(_cmp(spark, sf_dir), A, B), A, B)


@register("transfer_summary", _sql("""
select from_store, to_store, priority, count(*) as recommendations, cast(sum(qty) as bigint) as units
from recs group by from_store, to_store, priority"""))
def q_transfer_summary(spark, sf_dir):
    return cp.transfer_summary(cp.transfer_recs(_cmp(spark, sf_dir), A, B))


@register("category_compare", _sql(f"""
select type, count(*) filter (where store = '{A}') as products_a,
       cast(coalesce(sum(qty) filter (where store = '{A}'), 0) as bigint) as units_a,
       count(*) filter (where store = '{B}') as products_b,
       cast(coalesce(sum(qty) filter (where store = '{B}'), 0) as bigint) as units_b
from pm where store in ('{A}', '{B}') group by type"""))
def q_category_compare(spark, sf_dir):
    return cp.category_compare(_pm(spark, sf_dir), A, B)


@register("top_brands", _sql("""
select * from (
  select store, brand, count(*) as products, cast(sum(qty) as bigint) as units,
         row_number() over (partition by store order by sum(qty) desc, brand) as rank
  from pm group by store, brand) t
where rank <= 20"""))
def q_top_brands(spark, sf_dir):
    return cp.top_brands(_pm(spark, sf_dir))


@register("low_stock", _sql("select store, brand, product_name, type, rooms, qty from pm "
                            "where qty > 0 and qty <= 2"))
def q_low_stock(spark, sf_dir):
    return cp.low_stock(_pm(spark, sf_dir))


# stock after 40 units of every package line are sold: some products run out
_SOLD = _BASE.replace("qty_on_hand as qty", "greatest(qty_on_hand - 40, 0) as qty")


@register("zero_stock", with_views("select store, brand, product_name, type, rooms, qty from pm where qty = 0", "inventory",
                                   extra=[("pm_base", _SOLD), ("pm", _PM)]))
def q_zero_stock(spark, sf_dir):
    inv = fx.inventory(spark, sf_dir).withColumn("qty_on_hand", F.greatest(F.col("qty_on_hand") - 40, F.lit(0)))
    return cp.zero_stock(cp.product_map(inv, fx.ord_key()))
