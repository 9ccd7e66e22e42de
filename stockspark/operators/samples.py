"""Sample stock: free samples (wholesale cost <= 0.01) and their summaries
(F11, F12, A12, A13, U3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.functions.text import barcode_tail, format_currency

# ---- fixed values: sample rules
SAMPLE_COST_THRESHOLD = 0.01
EXCLUDED_TYPES = ["accessories"]
BACKSTOCK_ROOMS = ["backstock"]


def sample_items(df: DataFrame, rooms: Sequence[str] | None = None,
                 types: Sequence[str] | None = None, cost_col: str = "wholesale_cost",
                 null_cost_is_sample: bool = True) -> DataFrame:
    """cost <= 0.01 (an unparseable cost counts as 0.0, as the tool
    does, unless ``null_cost_is_sample`` is off); type not exactly
    "accessories"; optional room and type lists."""
    cost = F.col(cost_col).cast("double")
    if null_cost_is_sample:
        cost = F.coalesce(cost, F.lit(0.0))
    out = df.where(cost <= SAMPLE_COST_THRESHOLD)
    out = out.where(~F.coalesce(F.lower(F.trim(F.col("type"))).isin(EXCLUDED_TYPES), F.lit(False)))
    if rooms:
        out = out.where(F.col("room").isin(list(rooms)))
    if types:
        out = out.where(F.col("type").isin(list(types)))
    return out


def sort_samples(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("type").asc_nulls_last(), F.col("brand").asc_nulls_last(),
                      F.col("product_name").asc_nulls_last())


def sample_backstock(samples: DataFrame) -> DataFrame:
    """sample rows in the back stock room."""
    return samples.where(F.lower(F.trim(F.col("room"))).isin(BACKSTOCK_ROOMS))


def sample_summary(samples: DataFrame, group_col: str, label: str,
                   include_retail: bool = False) -> DataFrame:
    """Per group count and qty (and retail value = sum(qty * price) as
    currency text), plus a TOTAL row (rollup + grouping id)."""
    grp = F.coalesce(F.col(group_col).cast("string"), F.lit("Unknown"))
    qty = F.coalesce(F.col("qty_on_hand").cast("double"), F.lit(0.0))
    base = samples.select(grp.alias("_g"), qty.alias("_q"),
                          (qty * F.coalesce(F.col("unit_price").cast("double"), F.lit(0.0))).alias("_v"))
    aggs = [F.count(F.lit(1)).alias("sample_count"), F.sum("_q").cast("long").alias("total_qty")]
    if include_retail:
        aggs.append(F.sum("_v").alias("_retail"))
    r = base.rollup("_g").agg(*aggs, F.grouping_id().alias("_gid"))
    cols = [F.when(F.col("_gid") == 1, F.lit("TOTAL")).otherwise(F.col("_g")).alias(label),
            "sample_count", "total_qty"]
    if include_retail:
        cols.append(format_currency(F.col("_retail")).alias("total_retail_value"))
    return r.select(*cols)


def samples_by_distributor(samples: DataFrame) -> DataFrame:
    """Per distributor count, qty and the sorted distinct brands joined
    by ", "; a TOTAL row with '' for brands. The total is summed from the
    per-distributor rows, so no set of all brands is ever built."""
    dist = F.trim(F.coalesce(F.col("distributor").cast("string"), F.lit("Unknown")))
    brand = F.coalesce(F.col("brand").cast("string"), F.lit(""))
    base = samples.select(dist.alias("distributor"),
                          F.coalesce(F.col("qty_on_hand").cast("double"), F.lit(0.0)).alias("_q"),
                          F.when((brand != "") & (F.lower(brand) != "nan"), brand).alias("_b"))
    per = base.groupBy("distributor").agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("_q").cast("long").alias("total_qty"),
        F.array_join(F.array_sort(F.collect_set("_b")), ", ").alias("brands"))
    total = per.agg(F.lit("TOTAL").alias("distributor"),
                    F.coalesce(F.sum("sample_count"), F.lit(0)).cast("long").alias("sample_count"),
                    F.coalesce(F.sum("total_qty"), F.lit(0)).cast("long").alias("total_qty"),
                    F.lit("").alias("brands"))
    return per.unionByName(total)


def basket_key(barcode: Column, metrc6: Column, *row: Column) -> Column:
    """U3 key: barcode, else METRC-6, else a hash of the whole row."""
    b = F.trim(F.coalesce(barcode.cast("string"), F.lit("")))
    m = F.trim(F.coalesce(metrc6.cast("string"), F.lit("")))
    return (F.when(b != "", b).when(m != "", m)
             .otherwise(F.xxhash64(*row).cast("string")))


def distribution_list(selected: DataFrame, order: Column, cols: Sequence[str]) -> DataFrame:
    """Add rows once per key (first by ``order``)."""
    keyed = selected.select(
        basket_key(F.col("package_barcode"), barcode_tail(F.col("package_barcode"), 6, True),
                   *[F.col(c) for c in cols]).alias("basket_key"),
        F.struct(*cols).alias("_row"), order.alias("_ord"))
    first = keyed.groupBy("basket_key").agg(F.min_by("_row", "_ord").alias("_row"))
    return first.select("basket_key", "_row.*")


def remove_from_basket(basket: DataFrame, keys: DataFrame) -> DataFrame:
    """U3 removal: drop basket rows whose key is in ``keys`` (left anti)."""
    k = keys.select(F.col(keys.columns[0]).alias("basket_key"))
    return basket.join(k, "basket_key", "left_anti")
