"""Inventory-shaped views over the driver's parquet tables (FIXTURES.md B).

Each builder reads only the columns it needs so the parquet scan prunes
columns; joins are left to the planner (AQE turns the dimension joins into
broadcast joins only when their measured size is below the threshold).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: fixture parameters (FIXTURES.md B2, B5)
ROOM_ALIASES = {"SF": "Sales Floor", "Vault 1": "Vault"}
STORE_A, STORE_B = "A", "B"
EXPIRY_AS_OF = _dt.date(2001, 1, 1)
VELOCITY_AS_OF = _dt.date(2024, 1, 31)

ORD_COLS = ["ord_1", "ord_2", "ord_3", "ord_4", "ord_5", "ord_6"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped inventory: one row per package per room (FIXTURES.md B1)."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_extendedprice", "l_quantity", "l_discount")
    part = _read(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    supp = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = (li.join(part, li.l_partkey == part.p_partkey)
           .join(supp, li.l_suppkey == supp.s_suppkey))
    room = (F.when(F.col("l_linenumber") == 1, "Sales Floor")
             .when(F.col("l_linenumber") == 2, "Backstock")
             .when(F.col("l_linenumber") == 3, "Vault 1")
             .when(F.col("l_linenumber") == 4, "Incoming Deliveries")
             .when(F.col("l_linenumber") == 5, "Overflow")
             .when(F.col("l_linenumber") == 6, "SF")
             .otherwise("Sample Vault"))
    expiry_offset = ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 140 - 20).cast("int")
    return j.select(
        F.col("l_orderkey").alias("ord_1"),
        F.col("l_linenumber").alias("ord_2"),
        F.col("l_partkey").alias("ord_3"),
        F.col("l_suppkey").alias("ord_4"),
        F.col("l_shipdate").alias("ord_5"),
        F.col("l_extendedprice").alias("ord_6"),
        F.when(F.col("p_type") == "SMALL", "Accessories").otherwise(F.col("p_type")).alias("type"),
        F.col("p_brand").alias("brand"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("l_partkey").cast("string"), F.lit("-"),
                 (F.col("l_orderkey") % 10).cast("string")).alias("product_name"),
        F.concat(F.lit("1A4"), F.lpad(F.col("l_partkey").cast("string"), 13, "0"),
                 F.lpad(F.col("l_suppkey").cast("string"), 8, "0")).alias("package_barcode"),
        room.alias("room"),
        F.floor("l_quantity").cast("int").alias("qty_on_hand"),
        F.col("s_name").alias("distributor"),
        F.when(F.col("l_suppkey") % 2 == 0, STORE_A).otherwise(STORE_B).alias("store"),
        F.col("p_size").cast("string").alias("size"),
        F.to_date("l_shipdate").alias("received_date"),
        F.when(F.col("l_discount") == 0, F.lit(0.0))
         .otherwise(F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("wholesale_cost"),
        F.col("p_retailprice").alias("unit_price"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit(_dt.date(2001, 1, 1)), expiry_offset)).alias("expiration_date"),
    )


def ord_key() -> F.Column:
    """Total arrival order of inventory rows (the six ord_* columns are unique)."""
    return F.struct(*[F.col(c) for c in ORD_COLS])


def snapshot_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat snapshot history (FIXTURES.md B3).

    Items that sold out are those whose last event is before the newest day.
    """
    ev = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        F.to_date("ts").alias("snapshot_date"),
        F.col("event_id").alias("entry_idx"),
        F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("barcode"),
        F.col("event_type").alias("room"),
        F.floor(F.col("value") / 50).cast("int").alias("qty"),
    )


def import_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot history of two stores with two imports a day (FIXTURES.md B3a)."""
    ev = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    store = F.when(F.col("user_id") % 2 == 0, STORE_A).otherwise(STORE_B)
    taken = F.date_trunc("day", "ts") + F.when(F.hour("ts") < 12, F.expr("interval 11 hours")).otherwise(
        F.expr("interval 23 hours"))
    return (ev.withColumn("store", store).withColumn("snapshot_ts", taken.cast("timestamp")).select(
        "store", F.concat("store", F.lit("-"), F.date_format("snapshot_ts", "yyyyMMddHH")).alias("import_id"),
        "snapshot_ts", F.to_date("snapshot_ts").alias("snapshot_date"), F.col("event_id").alias("entry_idx"),
        F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("barcode"),
        F.col("event_type").alias("room"), F.floor(F.col("value") / 50).cast("int").alias("qty")))


def import_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as yearly imports of each store (FIXTURES.md B1a): rows with
    the import's identity; some rows lack a brand, as raw exports do."""
    inv = inventory(spark, sf_dir)
    year = F.year("received_date")
    return inv.select(
        *[F.when(F.col("ord_3") % 29 != 0, F.col("brand")).alias("brand") if c == "brand" else F.col(c)
          for c in inv.columns],
        F.concat("store", F.lit("-"), year.cast("string")).alias("import_id"),
        F.make_timestamp(year, F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("import_ts"))


def current_by_store(entries: DataFrame) -> DataFrame:
    """Each store's newest import, first entry per barcode."""
    newest = entries.groupBy("store").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return (entries.join(newest, ["store", "snapshot_ts"], "left_semi").groupBy("store", "barcode")
                   .agg(F.min("entry_idx").alias("entry_idx"), F.min_by("room", "entry_idx").alias("room"),
                        F.min_by("qty", "entry_idx").alias("qty")))


def current_items(spark: SparkSession, sf_dir: str, entries: DataFrame | None = None) -> DataFrame:
    """Newest snapshot, first entry per barcode (FIXTURES.md B4).

    The newest date is a scalar subquery; "first entry" is ``min_by`` in a
    grouped aggregate (partial aggregation, no window).
    """
    e = entries if entries is not None else snapshot_entry(spark, sf_dir)
    last_day = e.select(F.max("snapshot_date")).scalar()
    first = (e.where(F.col("snapshot_date") == last_day)
              .groupBy("barcode")
              .agg(F.min_by(F.struct("snapshot_date", "entry_idx", "room", "qty"),
                            F.col("entry_idx")).alias("r")))
    return first.select(F.col("r.snapshot_date").alias("snapshot_date"),
                        F.col("r.entry_idx").alias("entry_idx"),
                        "barcode",
                        F.col("r.room").alias("room"),
                        F.col("r.qty").alias("qty"))


# ---- user-state tables derived from the data (M7). They grow with the data,
# so they are joined, never collected.

def excluded_barcodes(inv: DataFrame) -> DataFrame:
    """Barcodes a user hid: near-empty back-room packages (qty <= 2 in Backstock)."""
    return (inv.where((F.col("room") == "Backstock") & (F.col("qty_on_hand") <= 2))
               .select(F.trim("package_barcode").alias("barcode")).distinct())


def priority_barcodes(inv: DataFrame) -> DataFrame:
    """Barcodes a user starred: packages holding 48 or more units."""
    return (inv.where(F.col("qty_on_hand") >= 48)
               .select(F.trim("package_barcode").alias("barcode")).distinct())
