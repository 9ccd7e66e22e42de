"""Multi-table reports (S9): several named results from one pass over the inventory.

The shared part (store comparison, sample aggregates) is worked out and
written once in the shared folder; every named output reads that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stockspark.functions.text import format_currency
from stockspark.operators import compare as cp
from stockspark.operators.restock import PRODUCT_KEY, in_rooms, is_accessory, is_sales_floor, with_selected
from stockspark.functions.rooms import normalize_rooms_df
from stockspark.session import scratch_path

COMPARISON = ["only_a", "only_b", "both_stores", "imbalances", "transfer_recs"]
SAMPLES = ["by_brand", "by_type", "by_room"]


def _once(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def comparison_report(inv: DataFrame, order: Column, a: str = "A", b: str = "B") -> dict[str, DataFrame]:
    """The five tables of a store comparison; the inventory is read once, when this is called."""
    both = _once(cp.store_comparison(cp.product_map(inv, order), a, b), "report-comparison")
    return {"only_a": cp.only_in(both, "a"), "only_b": cp.only_in(both, "b"), "both_stores": cp.both_stores(both),
            "imbalances": cp.imbalances(both, a, b), "transfer_recs": cp.transfer_recs(both, a, b)}


def samples_report(samples: DataFrame) -> dict[str, DataFrame]:
    """The three sample summaries with their TOTAL rows: one aggregation over grouping sets, written once."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in ("brand", "type", "room")]
    qty = F.coalesce(F.col("qty_on_hand").cast("double"), F.lit(0.0))
    rows = samples.select(*text, qty.alias("_q"), (qty * F.coalesce(F.col("unit_price").cast("double"), F.lit(0.0))).alias("_v"))
    sets = [["brand"], ["type"], ["room"], []]
    table = _once(rows.groupingSets([[F.col(c) for c in s] for s in sets], "brand", "type", "room").agg(
        F.count(F.lit(1)).alias("sample_count"), F.coalesce(F.sum("_q"), F.lit(0.0)).cast("long").alias("total_qty"),
        F.sum("_v").alias("_retail"), F.grouping_id().alias("_set")), "report-samples")
    # one bit a column that is not grouped by: brand, type, room
    out = {}
    for name, column, bits in (("by_brand", "brand", 0b011), ("by_type", "type", 0b101), ("by_room", "room", 0b110)):
        label = F.when(F.col("_set") == 0b111, F.lit("TOTAL")).otherwise(F.col(column)).alias(column)
        extra = [format_currency(F.col("_retail")).alias("total_retail_value")] if column == "brand" else []
        out[name] = table.where(F.col("_set").isin(bits, 0b111)).select(label, "sample_count", "total_qty", *extra)
    return out


def move_up_report(df: DataFrame, candidate_rooms: Sequence[str], path: str, aliases: dict | None = None,
                   brands=None, types=None) -> dict[str, int]:
    """A2 by observation (M9): writes the move-up list to ``path`` and returns the row count after each stage.

    The input is scanned once: the stages are counted while its candidates and floor products are written,
    the rest while the list is written. Both counts are taken in the writing stages, where a lost
    executor's tasks count once.
    """
    complete = [F.col(c).isNotNull() for c in ("product_name", "brand", "package_barcode", "room")]
    flagged = with_selected(with_selected(normalize_rooms_df(df, aliases), "brand", brands, "_brand"), "type", types, "_type")
    s1 = complete[0] & complete[1] & complete[2] & complete[3]
    staged = (flagged.withColumn("_s1", s1).withColumn("_s2", F.col("_s1") & F.col("_brand"))
              .withColumn("_s3", F.col("_s2") & F.col("_type"))
              .withColumn("_s4", F.col("_s3") & ~is_accessory(F.col("type")))
              .withColumn("_s5", F.col("_s4") & in_rooms(F.col("room"), list(candidate_rooms)))
              .withColumn("_floor", F.col("_s4") & is_sales_floor(F.col("room"))))
    stages, last = Observation("move-up stages"), Observation("move-up join")
    names = {"_s1": "after_dropna", "_s2": "after_brand", "_s3": "after_type_filter", "_s4": "after_type",
             "_s5": "candidate_pool"}
    seen = staged.observe(stages, F.count(F.lit(1)).alias("total_loaded"),
                          *[F.count_if(c).alias(n) for c, n in names.items()])
    kept = _once(seen.where("_s5 or _floor").select(*df.columns, "_s5", "_floor"), "move-up-stages")
    floor = kept.where("_floor").select(*PRODUCT_KEY).distinct().withColumn("_on_sf", F.lit(True))
    joined = kept.where("_s5").select(*df.columns).join(floor, PRODUCT_KEY, "left")
    joined = joined.observe(last, F.count_if(F.col("_on_sf").isNotNull()).alias("removed_as_on_sf"),
                            F.count_if(F.col("_on_sf").isNull()).alias("move_up"))
    joined.where("_on_sf is null").select(*df.columns).write.mode("overwrite").parquet(path)
    return {**stages.get, **last.get}
