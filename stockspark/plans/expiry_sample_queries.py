"""Registered queries: expiry windows and sample stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.operators import expiring as ex
from stockspark.operators import samples as sm
from stockspark.plans.registry import register
from stockspark.plans.views import with_views

AS_OF = fx.EXPIRY_AS_OF.isoformat()
# ---- fixed values: fixture parameters
DAYS = 90
EXCLUDE = ["accessories"]

METRC6_SQL = ("case when length(regexp_replace(trim(package_barcode), '[^0-9]+', '', 'g')) > 0 "
              "then right(regexp_replace(trim(package_barcode), '[^0-9]+', '', 'g'), 6) "
              "else right(trim(package_barcode), 6) end")
_EM = f"""
select room as location, type as category, {METRC6_SQL} as metrc6, brand, product_name,
       package_barcode, expiration_date, qty_on_hand as available_qty
from inventory"""
_EX = f"""
select *, cast(date_diff('day', date '{AS_OF}', expiration_date) as integer) as days_to_expire from em
where ((expiration_date is not null and expiration_date <= date '{AS_OF}' + {DAYS})
       or expiration_date is null)
  and not regexp_matches(lower(concat_ws(' | ', coalesce(category, ''), coalesce(metrc6, ''),
                                         coalesce(product_name, ''))), '{"|".join(EXCLUDE)}')"""


def _xsql(body: str) -> str:
    return with_views(body, "inventory", extra=[("em", _EM), ("ex", _EX)])


def _filtered(spark, sf_dir):
    em = ex.expiry_model(fx.inventory(spark, sf_dir))
    return ex.expiring_items(em, fx.EXPIRY_AS_OF, DAYS, True, True, EXCLUDE)


@register("expiring_items", _xsql("select * from ex"))
def q_expiring_items(spark, sf_dir):
    return ex.sort_expiring(_filtered(spark, sf_dir))


@register("expiry_buckets", _xsql(f"""
select b.pos, b.bucket, count(e.days_to_expire) as items,
       coalesce(sum(cast(e.available_qty as double)), 0.0) as qty_sum,
       min(e.expiration_date) as earliest_exp, max(e.expiration_date) as latest_exp
from (values (0, '0–7 days', 0, 7),
                       (1, '8–14 days', 8, 14),
                       (2, '15–30 days', 15, 30),
                       (3, '31–60 days', 31, 60),
                       (4, '61–90 days', 61, 90)) b(pos, bucket, lo, hi)
left join ex e on e.days_to_expire between b.lo and b.hi
group by b.pos, b.bucket
union all
select -1, 'Expired', count(*), coalesce(sum(cast(available_qty as double)), 0.0),
       min(expiration_date), max(expiration_date)
from ex where days_to_expire < 0 having count(*) > 0
union all
select 5, 'Missing Expiration', count(*), coalesce(sum(cast(available_qty as double)), 0.0),
       cast(null as date), cast(null as date)
from ex where expiration_date is null"""))
def q_expiry_buckets(spark, sf_dir):
    return ex.expiry_buckets(_filtered(spark, sf_dir), DAYS, True, True)


@register("expiry_action_list", _xsql("""
select location, category, metrc6, brand, product_name, expiration_date, days_to_expire, available_qty
from ex"""))
def q_expiry_action_list(spark, sf_dir):
    return ex.expiry_action_list(_filtered(spark, sf_dir))


@register("expiry_urgency", _xsql("""
select package_barcode, days_to_expire,
       case when days_to_expire is null then 'normal' when days_to_expire <= 7 then 'critical'
            when days_to_expire <= 14 then 'warning' else 'normal' end as urgency,
       case when days_to_expire is not null and days_to_expire <= 30 then 'expiring_soon'
            else 'normal' end as sample_tag
from ex"""))
def q_expiry_urgency(spark, sf_dir):
    f = _filtered(spark, sf_dir)
    d = F.col("days_to_expire")
    return f.select("package_barcode", "days_to_expire", ex.expiry_urgency(d).alias("urgency"),
                    ex.sample_expiry_tag(d).alias("sample_tag"))


# ------------------------------------------------------------------ samples

SAMPLE_COLS = ["type", "brand", "product_name", "package_barcode", "room", "qty_on_hand",
               "distributor", "wholesale_cost", "unit_price"]
_S = f"""
select {", ".join(SAMPLE_COLS)}, ord_1, ord_2, ord_3, ord_4, ord_5, ord_6 from inventory
where coalesce(wholesale_cost, 0.0) <= 0.01
  and not coalesce(lower(trim(type)) in ('accessories'), false)"""


def _ssql(body: str) -> str:
    return with_views(body, "inventory", extra=[("s", _S)])


def _samples(spark, sf_dir):
    return sm.sample_items(fx.inventory(spark, sf_dir))


@register("sample_items", _ssql(f"select {', '.join(SAMPLE_COLS)} from s"))
def q_sample_items(spark, sf_dir):
    return sm.sort_samples(_samples(spark, sf_dir).select(*SAMPLE_COLS))


@register("sample_backstock", _ssql(f"select {', '.join(SAMPLE_COLS)} from s "
                                    "where lower(trim(room)) in ('backstock')"))
def q_sample_backstock(spark, sf_dir):
    return sm.sort_samples(sm.sample_backstock(_samples(spark, sf_dir)).select(*SAMPLE_COLS))


def _summary_sql(col: str, label: str, retail: bool) -> str:
    rv = (", '$' || format('{:,.2f}', sum(cast(qty_on_hand as double) * coalesce(unit_price, 0.0)))"
          " as total_retail_value") if retail else ""
    return _ssql(f"""
select case when grouping(g) = 1 then 'TOTAL' else g end as {label},
       count(*) as sample_count, cast(sum(cast(qty_on_hand as double)) as bigint) as total_qty{rv}
from (select *, coalesce(cast({col} as varchar), 'Unknown') as g from s) t
group by rollup (g)""")


@register("samples_by_brand", _summary_sql("brand", "brand", True))
def q_samples_by_brand(spark, sf_dir):
    return sm.sample_summary(_samples(spark, sf_dir), "brand", "brand", include_retail=True)


@register("samples_by_type", _summary_sql("type", "type", False))
def q_samples_by_type(spark, sf_dir):
    return sm.sample_summary(_samples(spark, sf_dir), "type", "type")


@register("samples_by_room", _summary_sql("room", "room", False))
def q_samples_by_room(spark, sf_dir):
    return sm.sample_summary(_samples(spark, sf_dir), "room", "room")


@register("samples_by_distributor", _ssql("""
select distributor, count(*) as sample_count, cast(sum(cast(qty_on_hand as double)) as bigint) as total_qty,
       array_to_string(list_sort(list_distinct(list(brand) filter (where brand is not null and brand <> ''
                                                                  and lower(brand) <> 'nan'))), ', ') as brands
from (select *, trim(coalesce(distributor, 'Unknown')) as distributor2 from s) t
group by distributor
union all
select 'TOTAL', count(*), cast(sum(cast(qty_on_hand as double)) as bigint), '' from s"""))
def q_samples_by_distributor(spark, sf_dir):
    return sm.samples_by_distributor(_samples(spark, sf_dir))


_BASKET_COLS = ["type", "brand", "product_name", "package_barcode", "room", "qty_on_hand"]


@register("distribution_list", _ssql(f"""
select basket_key, {", ".join(_BASKET_COLS)} from (
  select trim(package_barcode) as basket_key, {", ".join(_BASKET_COLS)},
         row_number() over (partition by trim(package_barcode)
                            order by ord_1, ord_2, ord_3, ord_4, ord_5, ord_6) as rn
  from s) t where rn = 1"""))
def q_distribution_list(spark, sf_dir):
    return sm.distribution_list(_samples(spark, sf_dir), fx.ord_key(), _BASKET_COLS)
