"""User state against the data: excluded / priority sets, selections,
defaults, row status (F6, F7, F13, F14, F16, J10-J12, U2, D3-D5, A19).

User sets are DataFrames of barcodes; they are joined (semi / anti), never
collected. Broadcast is left to the planner, which checks their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.functions.rooms import alias_room
from stockspark.functions.tables import literal_table
from stockspark.schema import SALES_FLOOR_ALIASES


def _bc(c: str = "package_barcode") -> Column:
    return F.trim(F.col(c))


def _members(s: DataFrame) -> DataFrame:
    """Trimmed barcodes of a set; semi and anti joins need no distinct."""
    return s.select(F.trim(F.col(s.columns[0])).alias("_sb"))


def _keys(s: DataFrame) -> DataFrame:
    return _members(s).distinct()


def hide_excluded(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """drop rows whose trimmed barcode is in the excluded set."""
    return df.join(_members(excluded), _bc() == F.col("_sb"), "left_anti")


def rows_in_set(df: DataFrame, barcodes: DataFrame) -> DataFrame:
    """rows whose trimmed barcode is in the set (sort: room, brand, product)."""
    return df.join(_members(barcodes), _bc() == F.col("_sb"), "left_semi")


def prune_state(state: DataFrame, inv: DataFrame) -> DataFrame:
    """Keep saved barcodes that still exist in the inventory."""
    present = inv.select(_bc().alias("_ib"))
    return _keys(state).join(present, F.col("_sb") == F.col("_ib"), "left_semi") \
                       .select(F.col("_sb").alias("barcode"))


def export_rows(move_up: DataFrame, priority: DataFrame) -> DataFrame:
    """Move-up rows without the priority barcodes (listed separately)."""
    return move_up.join(_members(priority), _bc() == F.col("_sb"), "left_anti")


def brands_for_distributors(inv: DataFrame, distributors: Sequence[str] | DataFrame) -> DataFrame:
    """Sorted distinct brands carried by any chosen distributor."""
    d = F.trim(F.coalesce(F.col("distributor"), F.lit("")))
    d = F.when(d == "", F.lit("Unknown Distributor")).otherwise(d)
    base = inv.select(d.alias("_d"), F.trim("brand").alias("brand"))
    if isinstance(distributors, DataFrame):
        sel = distributors.select(F.col(distributors.columns[0]).alias("_sd"))
        base = base.join(sel, F.col("_d") == F.col("_sd"), "left_semi")
    else:
        base = base.where(F.col("_d").isin(list(distributors)))
    return base.where(F.col("brand").isNotNull() & (F.col("brand") != "")).select("brand").distinct()


def toggle_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of exactly one of two barcode sets."""
    ka = _keys(a).withColumn("_a", F.lit(True))
    kb = _keys(b).withColumn("_b", F.lit(True))
    j = ka.join(kb, "_sb", "full_outer")
    return j.where(F.col("_a").isNull() | F.col("_b").isNull()).select(F.col("_sb").alias("barcode"))


def list_values(df: DataFrame, col: str, aliases: dict | None = None) -> DataFrame:
    """Sorted distinct trimmed values (rooms after aliasing); blanks dropped
    for brands and types."""
    v = F.trim(F.col(col).cast("string"))
    if col == "room":
        v = alias_room(F.col(col), aliases)
        return df.where(F.col(col).isNotNull()).select(v.alias(col)).distinct().orderBy(col)
    return df.where(F.col(col).isNotNull()).select(v.alias(col)).where(F.col(col) != "") \
             .distinct().orderBy(col)


def default_rooms(df: DataFrame, aliases: dict | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """D3: Incoming Deliveries + Backstock when both exist, else every room
    that is not a sales-floor alias, else all rooms. Works on the distinct
    rooms only (one small array per ``keys`` group)."""
    rooms = (df.where(F.col("room").isNotNull())
               .select(*keys, alias_room(F.col("room"), aliases).alias("room")).distinct())
    per = rooms.groupBy(*keys).agg(F.array_sort(F.collect_set("room")).alias("_rooms"))
    lower_of = lambda x: F.lower(F.trim(x))
    floor = [*SALES_FLOOR_ALIASES, "sales floor"]

    def last_match(name: str) -> Column:
        m = F.filter("_rooms", lambda r: lower_of(r) == name)
        return F.try_element_at(m, F.lit(-1))

    has_both = (F.size(F.filter("_rooms", lambda r: lower_of(r) == "incoming deliveries")) > 0) & \
               (F.size(F.filter("_rooms", lambda r: lower_of(r) == "backstock")) > 0)
    non_floor = F.filter("_rooms", lambda r: ~lower_of(r).isin(floor))
    chosen = (F.when(has_both, F.array(last_match("incoming deliveries"), last_match("backstock")))
               .when(F.size(non_floor) > 0, non_floor).otherwise(F.col("_rooms")))
    return per.select(*keys, F.posexplode(chosen).alias("pos", "room"))


def effective_filters(df: DataFrame, saved_rooms: Sequence[str], saved_brands: Sequence[str],
                      saved_types: Sequence[str], aliases: dict | None = None) -> DataFrame:
    """Saved selections that still exist; rooms fall back to D3, brands
    and types to ALL. Rows (filter, value)."""
    spark = df.sparkSession

    def saved(kind: str, values: Sequence[str]) -> DataFrame:
        return literal_table(spark, [(kind, v) for v in values], "filter string, value string")

    rooms_now = list_values(df, "room", aliases).select(F.col("room").alias("value"))
    brands_now = list_values(df, "brand").select(F.col("brand").alias("value"))
    types_now = list_values(df, "type").select(F.col("type").alias("value"))
    kept_rooms = saved("rooms", saved_rooms).join(rooms_now, "value", "left_semi")
    kept_brands = saved("brands", saved_brands).join(brands_now, "value", "left_semi")
    kept_types = saved("types", saved_types).join(types_now, "value", "left_semi")
    fallback_rooms = default_rooms(df, aliases).select(F.lit("rooms").alias("filter"),
                                                       F.col("room").alias("value"))
    all_b = literal_table(spark, [("brands", "ALL")], "filter string, value string")
    all_t = literal_table(spark, [("types", "ALL")], "filter string, value string")
    # every filter keeps its saved values if any survive, else its fallback:
    # rank the two sources and keep the best rank per filter (equi join)
    cands = (kept_rooms.withColumn("_src", F.lit(0))
             .unionByName(fallback_rooms.withColumn("_src", F.lit(1)))
             .unionByName(kept_brands.withColumn("_src", F.lit(0)))
             .unionByName(all_b.withColumn("_src", F.lit(1)))
             .unionByName(kept_types.withColumn("_src", F.lit(0)))
             .unionByName(all_t.withColumn("_src", F.lit(1))))
    best = cands.groupBy("filter").agg(F.min("_src").alias("_src"))
    return cands.join(best, ["filter", "_src"]).drop("_src")


def row_status(df: DataFrame, priority: DataFrame, excluded: DataFrame, vel: DataFrame | None = None,
               hide_removed: bool = False) -> DataFrame:
    """Priority > backstock > excluded > slow > fast > normal."""
    p = _keys(priority).select(F.col("_sb").alias("_pb"), F.lit(True).alias("_is_p"))
    e = _keys(excluded).select(F.col("_sb").alias("_eb"), F.lit(True).alias("_is_e"))
    out = (df.join(p, _bc() == F.col("_pb"), "left").join(e, _bc() == F.col("_eb"), "left"))
    if vel is not None:
        v = vel.select(F.col("barcode").alias("_vb"), F.col("velocity_label").alias("_vl"))
        out = out.join(v, _bc() == F.col("_vb"), "left")
        lab = F.coalesce(F.col("_vl"), F.lit("New"))
    else:
        lab = F.lit("New")
    back = F.lower(F.trim(F.col("room"))) == "backstock"
    is_e = F.col("_is_e").isNotNull() & (_bc() != "") & F.lit(not hide_removed)
    status = (F.when(F.col("_is_p").isNotNull(), "priority").when(back, "backstock")
               .when(is_e, "excluded").when(lab.isin("Slow", "Stale"), "slow")
               .when(lab == "Fast", "fast").otherwise("normal"))
    return out.withColumn("row_status", status).drop("_pb", "_is_p", "_eb", "_is_e", "_vb", "_vl")


def audit_selection(df: DataFrame, types=None, brands=None, rooms=None, distributors=None,
                    aliases: dict | None = None) -> DataFrame:
    """four ``isin`` filters after blank distributor -> "Unknown
    Distributor" and room aliasing. None means no filter on that field."""
    d = F.trim(F.coalesce(F.col("distributor"), F.lit("")))
    out = df.withColumn("distributor", F.when(d == "", F.lit("Unknown Distributor")).otherwise(d)) \
            .withColumn("room", alias_room(F.col("room"), aliases))
    for col, vals in (("type", types), ("brand", brands), ("room", rooms), ("distributor", distributors)):
        if vals is not None:
            out = out.where(F.col(col).isin(list(vals)))
    return out


def accessory_audit(df: DataFrame) -> DataFrame:
    """the audit preset that selects only accessory types."""
    return df.where(F.coalesce(F.lower(F.col("type")).contains("accessor"), F.lit(False)))


def hide_rooms(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """F16: drop rows whose trimmed room is hidden."""
    return df.where(~F.coalesce(F.trim(F.col("room")).isin([h.strip() for h in hidden]), F.lit(False)))
