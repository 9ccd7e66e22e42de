"""Product maps and store comparison.

A product map is one row per (keys, brand, product). Two stores are compared
with one conditional aggregation over the product map grouped by product:
each product has at most one row per store, so ``max(when(store = A, ...))``
gives the A side and the B side in one shuffle -- the full outer join of the
two maps without a join, and with partial aggregation for hot products.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.functions.numeric import ratio_tenths, ratio_text, tenths_text
from stockspark.functions.parse import to_qty


def _rooms_fold(rooms: Column) -> Column:
    """Ordered fold: start with the first room; add a room only when it is
    non-empty and not a substring of the text so far."""
    return F.aggregate(
        F.slice(rooms, 2, F.greatest(F.size(rooms) - 1, F.lit(0))),
        F.try_element_at(rooms, F.lit(1)),
        lambda acc, r: F.when((r != "") & ~acc.contains(r), F.concat(acc, F.lit(", "), r)).otherwise(acc))


def product_map(df: DataFrame, order: Column, keys: Sequence[str] = ("store",)) -> DataFrame:
    """A3: per (keys, brand, product), trimmed: type of the first row, rooms
    text (ordered fold), qty sum.

    Repeated rooms never change the fold, so rows are first reduced to one
    row per (product, room) with its first arrival; the per-product room list
    is then bounded by the number of distinct rooms, never by the row count.
    These few rows are shuffled on the product alone, which also serves a
    comparison of stores. Every step sorts by a hash of the product first:
    text keys with a common beginning compare slowly.
    """
    base = df.select(*keys,
                     F.trim(F.coalesce("brand", F.lit(""))).alias("brand"),
                     F.trim(F.coalesce("product_name", F.lit(""))).alias("product_name"),
                     F.trim(F.coalesce("type", F.lit(""))).alias("type"),
                     F.trim(F.coalesce("room", F.lit(""))).alias("room"),
                     to_qty(F.col("qty_on_hand")).alias("qty"),
                     order.alias("_ord"))
    base = base.withColumn("_hash", F.xxhash64("brand", "product_name"))
    per_room = base.groupBy("_hash", *keys, "brand", "product_name", "room").agg(
        F.min("_ord").alias("_first"),
        F.min_by("type", "_ord").alias("_type"),
        F.sum("qty").alias("_qty"))
    per_prod = per_room.repartition("brand", "product_name").groupBy("_hash", *keys, "brand", "product_name").agg(
        F.min_by("_type", "_first").alias("type"),
        F.array_sort(F.collect_list(F.struct("_first", "room"))).alias("_rooms"),
        F.sum("_qty").cast("long").alias("qty"))
    return per_prod.select(*keys, "brand", "product_name", "type",
                           _rooms_fold(F.col("_rooms.room")).alias("rooms"), "qty")


def store_comparison(pm: DataFrame, a: str = "A", b: str = "B", store_col: str = "store") -> DataFrame:
    """One row per product of either store with both sides (null when absent)."""
    pm = pm.where(F.col(store_col).isin(a, b))

    def side(store: str, c: str) -> Column:
        return F.max(F.when(F.col(store_col) == store, F.col(c)))

    by_hash = F.xxhash64("brand", "product_name").alias("_hash")
    return pm.groupBy(by_hash, "brand", "product_name").agg(
        side(a, "type").alias("type_a"), side(a, "rooms").alias("rooms_a"), side(a, "qty").alias("qty_a"),
        side(b, "type").alias("type_b"), side(b, "rooms").alias("rooms_b"), side(b, "qty").alias("qty_b")).drop("_hash")


def only_in(cmp: DataFrame, side: str) -> DataFrame:
    """Products of one store only: type, brand, product, rooms, qty."""
    other = "b" if side == "a" else "a"
    return (cmp.where(F.col(f"qty_{side}").isNotNull() & F.col(f"qty_{other}").isNull())
               .select(F.col(f"type_{side}").alias("type"), "brand", "product_name",
                       F.col(f"rooms_{side}").alias("rooms"), F.col(f"qty_{side}").alias("qty")))


def both_stores(cmp: DataFrame) -> DataFrame:
    """Products in both stores: signed diff and the display imbalance flag
    (|diff| > half the larger qty and |diff| >= 3)."""
    diff = F.col("qty_a") - F.col("qty_b")
    return (cmp.where(F.col("qty_a").isNotNull() & F.col("qty_b").isNotNull())
               .select(F.col("type_a").alias("type"), "brand", "product_name", "rooms_a", "qty_a",
                       "rooms_b", "qty_b", diff.alias("diff"),
                       ((F.abs(diff) > F.greatest("qty_a", "qty_b") * 0.5) & (F.abs(diff) >= 3))
                       .alias("imbalanced")))


def _ratio_cols(qa: Column, qb: Column):
    bigger = F.greatest(qa, qb)
    smaller = F.greatest(F.least(qa, qb), F.lit(1))
    return bigger, smaller, bigger / smaller, F.abs(qa - qb)


def imbalances(cmp: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Both stores, ratio >= 2 and |diff| >= 3; ratio text as "3.2x"."""
    both = cmp.where(F.col("qty_a").isNotNull() & F.col("qty_b").isNotNull()
                     & ~((F.col("qty_a") == 0) & (F.col("qty_b") == 0)))
    bigger, smaller, ratio, diff = _ratio_cols(F.col("qty_a"), F.col("qty_b"))
    return (both.where((ratio >= 2.0) & (diff >= 3))
                .select(F.col("type_a").alias("type"), "brand", "product_name",
                        "qty_a", "qty_b", ratio_text(bigger, smaller).alias("ratio"),
                        F.when(F.col("qty_a") > F.col("qty_b"), a).otherwise(b).alias("overstocked")))


def sort_imbalances(df: DataFrame) -> DataFrame:
    """Rounded ratio descending, then product key (the reference's stable order)."""
    r = F.regexp_replace("ratio", "x$", "").cast("double")
    return df.orderBy(r.desc(), "brand", "product_name")


_PRIORITY_RANK = {"High": 0, "Medium": 1, "Low": 2}


def transfer_recs(cmp: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """One `when` chain over the comparison (each product is only-A,
    only-B or both, so the union of the three sources is a single pass)."""
    qa, qb = F.col("qty_a"), F.col("qty_b")
    only_a = qa.isNotNull() & qb.isNull()
    only_b = qb.isNotNull() & qa.isNull()
    both = qa.isNotNull() & qb.isNotNull()
    bigger, smaller, ratio, diff = _ratio_cols(qa, qb)
    imb = both & ~((qa == 0) & (qb == 0)) & (ratio >= 2.0) & (diff >= 3)
    one_qty = F.coalesce(qa, qb)
    keep = (only_a & (qa > 0)) | (only_b & (qb > 0)) | imb
    priority = (F.when(~both, F.when(one_qty >= 3, "High").otherwise("Medium"))
                 .when((ratio >= 3.0) & (diff >= 5), "Medium").otherwise("Low"))
    from_store = F.when(only_a, a).when(only_b, b).when(qa > qb, a).otherwise(b)
    to_store = F.when(only_a, b).when(only_b, a).when(qa > qb, b).otherwise(a)
    qty = F.when(~both, one_qty).otherwise(_half(diff))
    reason = (F.when(only_a, F.lit(f"Not at {b}")).when(only_b, F.lit(f"Not at {a}"))
               .otherwise(F.concat(F.lit("Imbalanced ("), tenths_text(F.col("_tenths"), ""), F.lit("x)"))))
    sort_rank = (F.when(~both, F.when(one_qty >= 3, 0).otherwise(1))
                  .when((ratio >= 3.0) & (diff >= 5), 1).otherwise(2))
    sort_qty = F.when(~both, one_qty).otherwise(diff)
    # the ratio is a column of its own: inside the chain it would be written out at each use
    rated = cmp.where(keep).withColumn("_tenths", ratio_tenths(bigger, smaller))
    return (rated.select(
        priority.alias("priority"), F.coalesce("type_a", "type_b").alias("type"), "brand",
        "product_name", from_store.alias("from_store"), to_store.alias("to_store"),
        qty.cast("long").alias("qty"), reason.alias("reason"),
        sort_rank.alias("sort_rank"), sort_qty.cast("long").alias("sort_units")))


def _half(x: Column) -> Column:
    return ((x - x % 2) / 2).cast("long")


def category_breakdown(pm: DataFrame, field: str, keys: Sequence[str] = ("store",)) -> DataFrame:
    """A4: products and units per type (or brand) and the average per product."""
    return pm.groupBy(*keys, field).agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("qty").cast("long").alias("units")).withColumn(
        "avg_qty", F.col("units") / F.greatest(F.col("products"), F.lit(1)))


def store_overview(pm: DataFrame, keys: Sequence[str] = ("store",)) -> DataFrame:
    """A5: products, units and units per product."""
    return pm.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_products"),
        F.sum("qty").cast("long").alias("total_units")).withColumn(
        "avg_units", F.col("total_units") / F.col("unique_products"))


def store_pair_overview(cmp: DataFrame) -> DataFrame:
    """Exclusive and shared counts, overlap % = shared / max(a, b, 1) * 100."""
    qa, qb = F.col("qty_a"), F.col("qty_b")
    agg = cmp.agg(
        F.count_if(qa.isNotNull()).alias("products_a"),
        F.count_if(qb.isNotNull()).alias("products_b"),
        F.coalesce(F.sum("qty_a"), F.lit(0)).cast("long").alias("units_a"),
        F.coalesce(F.sum("qty_b"), F.lit(0)).cast("long").alias("units_b"),
        F.count_if(qa.isNotNull() & qb.isNull()).alias("exclusive_a"),
        F.count_if(qb.isNotNull() & qa.isNull()).alias("exclusive_b"),
        F.count_if(qa.isNotNull() & qb.isNotNull()).alias("shared"))
    return agg.withColumn("overlap_pct", F.col("shared") / F.greatest(
        "products_a", "products_b", F.lit(1)) * 100)


def room_distribution(pm: DataFrame, keys: Sequence[str] = ("store",)) -> DataFrame:
    """Per room, products and units; a product in k rooms adds its whole
    qty to each room (as the report does)."""
    rooms = pm.select(*keys, "qty", F.explode(F.split("rooms", ", ")).alias("room"))
    rooms = rooms.withColumn("room", F.trim("room")).where(F.col("room") != "")
    return rooms.groupBy(*keys, "room").agg(
        F.count(F.lit(1)).alias("products"), F.sum("qty").cast("long").alias("units"))


def brand_gap(pm: DataFrame, a: str = "A", b: str = "B", top: int = 15) -> DataFrame:
    """Top brands by units over both stores; gap = a - b; flagged when
    |gap| > 0.4 * total and |gap| >= 5."""
    per = pm.where(F.col("store").isin(a, b)).groupBy("brand").agg(
        F.sum("qty").cast("long").alias("total"),
        F.coalesce(F.sum(F.when(F.col("store") == a, F.col("qty"))), F.lit(0)).cast("long").alias("qty_a"),
        F.coalesce(F.sum(F.when(F.col("store") == b, F.col("qty"))), F.lit(0)).cast("long").alias("qty_b"))
    topk = per.orderBy(F.col("total").desc(), "brand").limit(top)
    gap = F.col("qty_a") - F.col("qty_b")
    return topk.select("brand", "qty_a", "qty_b", "total", gap.alias("gap"),
                       ((F.abs(gap) > F.col("total") * 0.4) & (F.abs(gap) >= 5)).alias("flagged"))


def exclusive_by_type(cmp: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Per store, its exclusive products counted by type."""
    qa, qb = F.col("qty_a"), F.col("qty_b")
    excl = cmp.where(qa.isNull() != qb.isNull()).select(
        F.when(qa.isNotNull(), a).otherwise(b).alias("store"),
        F.coalesce("type_a", "type_b").alias("type"))
    return excl.groupBy("store", "type").agg(F.count(F.lit(1)).alias("products"))


def imbalance_summary(imb: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """A10: how many imbalances and at which store the stock is heavy."""
    return imb.agg(F.count(F.lit(1)).alias("imbalances"),
                   F.count_if(F.col("overstocked") == a).alias("overstocked_a"),
                   F.count_if(F.col("overstocked") == b).alias("overstocked_b"))


def transfer_summary(recs: DataFrame) -> DataFrame:
    """A10: recommendations and units by direction and priority."""
    return recs.groupBy("from_store", "to_store", "priority").agg(
        F.count(F.lit(1)).alias("recommendations"), F.sum("qty").cast("long").alias("units"))


def category_compare(pm: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Per type, products and units in each store, zero-filled."""
    s = F.col("store")

    def cnt(x):
        return F.count_if(s == x).alias(f"products_{x.lower()}")

    def units(x):
        return F.coalesce(F.sum(F.when(s == x, F.col("qty"))), F.lit(0)).cast("long").alias(f"units_{x.lower()}")

    return pm.where(s.isin(a, b)).groupBy("type").agg(cnt(a), units(a), cnt(b), units(b))


def top_brands(pm: DataFrame, top: int = 20, keys: Sequence[str] = ("store",)) -> DataFrame:
    """O3: per store the ``top`` brands by units (ties by brand name).

    The window runs over the brand table (one row per store and brand)."""
    per = category_breakdown(pm, "brand", keys)
    w = Window.partitionBy(*keys).orderBy(F.col("units").desc(), "brand")
    return (per.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
               .drop("avg_qty"))


def low_stock(pm: DataFrame) -> DataFrame:
    """products with 0 < qty <= 2 (the report lists them by qty)."""
    return pm.where((F.col("qty") > 0) & (F.col("qty") <= 2))


def zero_stock(pm: DataFrame) -> DataFrame:
    """products with qty = 0."""
    return pm.where(F.col("qty") == 0)
