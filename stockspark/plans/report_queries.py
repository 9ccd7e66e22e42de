"""Registered queries: multi-table reports written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.operators import reports as rp
from stockspark.plans.compare_queries import A, B, _sql
from stockspark.plans.expiry_sample_queries import _samples, _ssql
from stockspark.plans.registry import ORACLE, register
from stockspark.plans.restock_queries import CANDIDATE_ROOMS
from stockspark.session import scratch_path
from stockspark.sources import history_io as hio

_NONE = "cast(null as bigint)"
_REPORT = f"""
select 'only_a' as report, type_a as type, brand, product_name, qty_a, {_NONE} as qty_b, rooms_a as note
from cmp where qty_a is not null and qty_b is null
union all
select 'only_b', type_b, brand, product_name, {_NONE}, qty_b, rooms_b from cmp where qty_b is not null and qty_a is null
union all
select 'both_stores', type_a, brand, product_name, qty_a, qty_b, rooms_a || '|' || rooms_b
from cmp where qty_a is not null and qty_b is not null
union all
select 'imbalances', type, brand, product_name, qty_a, qty_b, ratio || '|' || overstocked from imb
union all
select 'transfer_recs', type, brand, product_name, qty, {_NONE}, priority || '|' || from_store || '|' || to_store || '|' || reason
from recs"""


@register("comparison_report", _sql(_REPORT))
def q_comparison_report(spark, sf_dir):
    """The five tables of a store comparison, written under one path and read back."""
    path = scratch_path(spark, "report")
    hio.write_report(rp.comparison_report(fx.inventory(spark, sf_dir), fx.ord_key(), A, B), path)

    def back(name, qty_a, qty_b, *note) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        value = [F.col(c).cast("long") if c else F.lit(None).cast("long") for c in (qty_a, qty_b)]
        return df.select(F.lit(name).alias("report"), "type", "brand", "product_name", value[0].alias("qty_a"),
                         value[1].alias("qty_b"), F.concat_ws("|", *note).alias("note"))
    return reduce(DataFrame.unionByName, [
        back("only_a", "qty", None, "rooms"), back("only_b", None, "qty", "rooms"),
        back("both_stores", "qty_a", "qty_b", "rooms_a", "rooms_b"),
        back("imbalances", "qty_a", "qty_b", "ratio", "overstocked"),
        back("transfer_recs", "qty", None, "priority", "from_store", "to_store", "reason")])


def _summary(name: str, column: str) -> str:
    value = ("'$' || format('{:,.2f}', sum(cast(qty_on_hand as double) * coalesce(unit_price, 0.0)))"
             if column == "brand" else "cast(null as varchar)")
    return f"""
select 'by_{name}' as report, case when grouping(g) = 1 then 'TOTAL' else g end as label, count(*) as sample_count,
       cast(sum(cast(qty_on_hand as double)) as bigint) as total_qty, {value} as total_retail_value
from (select *, coalesce(cast({column} as varchar), 'Unknown') as g from s) t group by rollup (g)"""


@register("samples_report", _ssql(" union all ".join(_summary(c, c) for c in ("brand", "type", "room"))))
def q_samples_report(spark, sf_dir):
    """The three sample summaries, written under one path and read back."""
    path = scratch_path(spark, "samples-report")
    hio.write_report(rp.samples_report(_samples(spark, sf_dir)), path)

    def back(name) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        value = F.col("total_retail_value") if "total_retail_value" in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(name).alias("report"), F.col(df.columns[0]).alias("label"), "sample_count", "total_qty",
                         value.alias("total_retail_value"))
    return reduce(DataFrame.unionByName, [back(n) for n in rp.SAMPLES])


@register("move_up_report", ORACLE["move_up_diag"])
def q_move_up_report(spark, sf_dir):
    """A2 / M9: the stage counts observed while the move-up list is written."""
    got = rp.move_up_report(fx.inventory(spark, sf_dir), CANDIDATE_ROOMS, scratch_path(spark, "move-up"), fx.ROOM_ALIASES)
    cols = ["total_loaded", "after_dropna", "after_brand", "after_type_filter", "after_type", "candidate_pool",
            "removed_as_on_sf", "move_up"]
    return spark.createDataFrame([tuple(got[c] for c in cols)], ", ".join(f"{c} long" for c in cols))
