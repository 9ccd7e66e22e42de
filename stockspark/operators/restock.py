"""Move-up: what sits in back rooms but not on the sales floor.

J1 anti join, A1 split-package merge, A2 stage diagnostics, F1-F5 filters,
O1 backstock-first order. Every function is lazy and takes ``keys`` so one
call serves many stores / imports at once (``keys=("store",)``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.functions.parse import to_qty
from stockspark.functions.rooms import in_rooms, is_sales_floor, normalize_rooms_df

PRODUCT_KEY = ["brand", "product_name"]
SPLIT_KEY = ["package_barcode", "room", "type", "brand", "product_name"]


# ---------------------------------------------------------------- filters

def drop_incomplete(df: DataFrame) -> DataFrame:
    """drop rows missing product, brand, barcode or room."""
    return df.dropna(subset=["product_name", "brand", "package_barcode", "room"])


def wanted(values: Sequence[str] | None) -> frozenset[str]:
    """The entries a selection asks for; an empty set selects everything.

    Blank entries say nothing, and an entry ALL (any case) lifts the selection.
    """
    entries = frozenset(str(v).strip() for v in values or ()) - {""}
    return frozenset() if "ALL" in map(str.upper, entries) else entries


def with_selected(df: DataFrame, col: str, values: Sequence[str] | DataFrame | None, flag: str) -> DataFrame:
    """``df`` with a boolean column: the row's value is selected.

    The row value itself is not trimmed. A DataFrame (one column, any size) is
    joined on its distinct values; a list is an IN predicate.
    """
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias("_v")).distinct().withColumn("_in", F.lit(True))
        joined = df.join(v, F.col(col) == F.col("_v"), "left")
        return joined.withColumn(flag, F.col("_in").isNotNull()).drop("_v", "_in")
    vals = wanted(values)
    return df.withColumn(flag, F.coalesce(F.col(col).isin(sorted(vals)), F.lit(False)) if vals else F.lit(True))


def filter_in(df: DataFrame, col: str, values: Sequence[str] | DataFrame | None) -> DataFrame:
    """keep rows whose value is in the list; an empty list or one holding
    "ALL" keeps all. A DataFrame list (one column, any size) is a semi join."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias("_v"))
        return df.join(v, F.col(col) == F.col("_v"), "left_semi")
    vals = wanted(values)
    return df.where(F.col(col).isin(sorted(vals))) if vals else df


def is_accessory(type_col: Column) -> Column:
    return F.coalesce(F.lower(type_col).contains("accessor"), F.lit(False))


def exclude_accessories(df: DataFrame) -> DataFrame:
    """drop types containing "accessor" (any case); null types are kept."""
    return df.where(~is_accessory(F.col("type")))


def sales_floor_items(df: DataFrame) -> DataFrame:
    """rows whose room is a sales-floor alias (case-insensitive)."""
    return df.where(is_sales_floor(F.col("room")))


def candidate_items(df: DataFrame, rooms: Sequence[str]) -> DataFrame:
    """rows whose trimmed room is a candidate room (case-sensitive)."""
    return df.where(in_rooms(F.col("room"), list(rooms)))


# ---------------------------------------------------------------- move-up

def prepare(df: DataFrame, aliases=None, brands=None, types=None) -> DataFrame:
    """Shared input of the floor set and the candidates: complete rows, brand
    and type selection, aliased rooms, no accessories. The brand / type
    selection shrinks the floor set too (filter order changes answers)."""
    work = drop_incomplete(df)
    work = filter_in(work, "brand", brands)
    work = filter_in(work, "type", types)
    work = normalize_rooms_df(work, aliases)
    return exclude_accessories(work)


def move_up(df: DataFrame, candidate_rooms: Sequence[str], aliases=None, brands=None,
            types=None, skip_sales_floor: bool = False,
            keys: Sequence[str] = ()) -> DataFrame:
    """Candidate-room rows whose (keys, brand, product) is not on the floor.

    The floor side is reduced to distinct products map-side. With AQE a hot product
    on the probe side is split into several tasks (skew join); a small floor
    side becomes a broadcast join at runtime.
    """
    work = prepare(df, aliases, brands, types)
    cands = candidate_items(work, candidate_rooms)
    if skip_sales_floor:
        return cands
    floor = sales_floor_items(work).select(*keys, *PRODUCT_KEY).distinct()
    return cands.join(floor, [*keys, *PRODUCT_KEY], "left_anti")


def move_up_diag(df: DataFrame, candidate_rooms: Sequence[str], aliases=None, brands=None,
                 types=None, skip_sales_floor: bool = False,
                 keys: Sequence[str] = ()) -> DataFrame:
    """A2: row count after each stage, one row per ``keys`` group.

    The stage counts come from one pass over the input; only the candidates
    take part in the join with the (distinct) floor keys. Both branches are
    aggregated before they meet, so no row-level data crosses the union.
    Invariant: candidate_pool = removed_as_on_sf + move_up.
    """
    complete = F.col("product_name").isNotNull() & F.col("brand").isNotNull() & \
        F.col("package_barcode").isNotNull() & F.col("room").isNotNull()
    flagged = with_selected(with_selected(normalize_rooms_df(df, aliases), "brand", brands, "_brand"),
                            "type", types, "_type")
    staged = (flagged.withColumn("_s1", complete).withColumn("_s2", F.col("_s1") & F.col("_brand"))
              .withColumn("_s3", F.col("_s2") & F.col("_type"))
              .withColumn("_s4", F.col("_s3") & ~is_accessory(F.col("type")))
              .withColumn("_s5", F.col("_s4") & in_rooms(F.col("room"), list(candidate_rooms))))
    zero = F.lit(0).cast("long")
    stage_counts = staged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_loaded"),
        F.count_if("_s1").alias("after_dropna"),
        F.count_if("_s2").alias("after_brand"),
        F.count_if("_s3").alias("after_type_filter"),
        F.count_if("_s4").alias("after_type"),
        F.count_if("_s5").alias("candidate_pool"),
        zero.alias("removed_as_on_sf"), zero.alias("move_up"))
    cands = staged.where("_s5").select(*keys, *PRODUCT_KEY)
    if skip_sales_floor:
        join_counts = cands.groupBy(*keys).agg(
            *[zero.alias(c) for c in ("total_loaded", "after_dropna", "after_brand",
                                      "after_type_filter", "after_type", "candidate_pool")],
            zero.alias("removed_as_on_sf"), F.count(F.lit(1)).alias("move_up"))
    else:
        floor = (staged.where(F.col("_s4") & is_sales_floor(F.col("room")))
                 .select(*keys, *PRODUCT_KEY).distinct().withColumn("_on_sf", F.lit(True)))
        joined = cands.join(floor, [*keys, *PRODUCT_KEY], "left")
        join_counts = joined.groupBy(*keys).agg(
            *[zero.alias(c) for c in ("total_loaded", "after_dropna", "after_brand",
                                      "after_type_filter", "after_type", "candidate_pool")],
            F.count_if(F.col("_on_sf").isNotNull()).alias("removed_as_on_sf"),
            F.count_if(F.col("_on_sf").isNull()).alias("move_up"))
    cols = ["total_loaded", "after_dropna", "after_brand", "after_type_filter", "after_type",
            "candidate_pool", "removed_as_on_sf", "move_up"]
    return (stage_counts.unionByName(join_counts).groupBy(*keys)
            .agg(*[F.sum(c).cast("long").alias(c) for c in cols]))


# ---------------------------------------------------------------- merge / sort

def backstock_first(room: Column) -> Column:
    return F.when(F.lower(F.trim(room)) == "backstock", 0).otherwise(1)


def backstock_sort(df: DataFrame, order: Column | None = None) -> DataFrame:
    """O1: Backstock rows first, then type, brand, product; stable on ``order``."""
    cols = [backstock_first(F.col("room")), "type", "brand", "product_name"]
    if order is not None:
        cols.append(order)
    return df.orderBy(*cols)


def split_packages(df: DataFrame, order: Column, extra: Sequence[str] | None = None,
                   sort: bool = True) -> DataFrame:
    """A1: merge rows of one package in one room.

    Group (barcode, room, type, brand, product) after trimming, sum the
    quantity, take the first non-null value of every other column in arrival
    ``order``; blank barcodes are dropped.

    The sorted list is cut into ranges of its leading columns before the merge: they
    are part of the merge key, so one shuffle of the rows serves both, and no
    row is widened to one state per column on its way. Within a range rows
    are merged in the order of a hash of the key; text keys with a common
    beginning compare slowly. Unsorted, partial aggregation runs before
    the shuffle.
    """
    if extra is None:
        extra = [c for c in df.columns if c not in SPLIT_KEY and c != "qty_on_hand"
                 and not c.startswith("ord_")]
    norm = df.select(
        *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in SPLIT_KEY],
        to_qty(F.col("qty_on_hand")).alias("qty_on_hand"),
        *[F.col(c) for c in extra],
        order.alias("_ord"),
    ).where(F.col("package_barcode") != "")
    leading = ["_place", "type", "brand", "product_name"]
    norm = norm.withColumn("_place", backstock_first(F.col("room")))
    if sort:
        norm = norm.repartitionByRange(*leading)
    aggs = [F.sum("qty_on_hand").cast("long").alias("qty_on_hand")]
    aggs += [F.expr(f"min_by(`{c}`, _ord) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in extra]
    aggs.append(F.min("_ord").alias("_first"))
    out = norm.groupBy(F.xxhash64(*SPLIT_KEY).alias("_hash"), "_place", *SPLIT_KEY).agg(*aggs)
    if sort:
        out = out.orderBy(*leading, "_first")
    return out.drop("_hash", "_place", "_first")
