"""Numbered listings (W9-W11) and ordered numbering without one big partition.

A window ``row_number() over (order by ...)`` without ``partition by`` moves
every row into one task. ``number_rows`` instead range-partitions on the sort
key, numbers rows inside each partition (``monotonically_increasing_id``
carries the in-partition position in its low 33 bits), and adds the running
total of the per-partition counts. The counts table has one row per
partition, so its size is bounded by the partition count and it is broadcast.

The tagged rows are written once as a table (in the shared
``spark.checkpoint.dir``): the counts and the numbering must see
the very same partitioning, and a lost executor must not re-sample the range
bounds differently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.session import scratch_path


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_rows(df: DataFrame, order: Sequence, name: str = "pos",
                partitions: int | None = None) -> DataFrame:
    """1-based position of every row in ``order`` (which must be a total order)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [_c(c) for c in order]
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_local", F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    # written once, compressed; an RDD checkpoint's files are several times as large
    path = scratch_path(spark, "numbered")
    ranged.write.option("compression", "zstd").parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = ranged.join(F.broadcast(offsets), "_pid", "left")
    return (out.withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local") + 1)
               .drop("_pid", "_local", "_off"))


def number_within_groups(df: DataFrame, group: Sequence[str], order: Sequence,
                         name: str = "rn", global_name: str | None = None) -> DataFrame:
    """1-based position inside each group plus (optionally) the global position.

    Global numbering over (group, order), then the group's first position is
    an aggregate joined back on the group key: no task holds a whole group.
    """
    g = "_gpos" if global_name is None else global_name
    numbered = number_rows(df, [*group, *order], g)
    starts = numbered.groupBy(*group).agg(F.min(g).alias("_gstart"))
    out = (numbered.join(starts, list(group), "left")
                   .withColumn(name, F.col(g) - F.col("_gstart") + 1)
                   .drop("_gstart"))
    return out if global_name is not None else out.drop(g)


# ---------------------------------------------------------------- audit listing

def _blank_to(c: str, default: str) -> Column:
    v = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.when(v == "", F.lit(default)).otherwise(v)


# ---- fixed values: audit sort modes -> (group column, sort keys)
AUDIT_MODES = {
    "distributor_type_size_product": ("distributor", ["distributor", "type", "size_full", "product_name"]),
    "brand_type_product": ("brand", ["brand", "type", "size_full", "product_name"]),
    "type_brand_product": ("type", ["type", "brand", "size_full", "product_name"]),
}


def audit_listing(df: DataFrame, order: Column, sort_mode: str = "type_brand_product",
                  rows_per_page: int = 35, default_store: str = "Store",
                  default_room: str = "Sales Floor", type_len: int = 7,
                  product_len: int = 75, tail_len: int = 8) -> DataFrame:
    """Numbered audit rows. Blanks filled (Unknown Distributor, default
    store and room); sorted by the mode's keys (stable on ``order``); item
    numbers run across groups; each group starts a new page and holds
    ``rows_per_page`` rows per page.

    Group page offsets come from a running sum over the per-group counts
    (one row per group), joined back on the group key.
    """
    from stockspark.functions.text import barcode_tail, ellipses, truncate_plain
    group_col, keys = AUDIT_MODES.get(sort_mode, AUDIT_MODES["type_brand_product"])
    work = df.select(
        "*",
        _blank_to("distributor", "Unknown Distributor").alias("_dist"),
        _blank_to("store", default_store or "Store").alias("_store"),
        _blank_to("room", default_room or "Sales Floor").alias("_room"),
        F.trim(F.coalesce(F.col("size").cast("string"), F.lit(""))).alias("size_full"),
        order.alias("_ord"))
    work = (work.drop("distributor", "store", "room")
                .withColumnRenamed("_dist", "distributor").withColumnRenamed("_store", "store")
                .withColumnRenamed("_room", "room"))
    work = work.where(F.trim(F.coalesce(F.col(group_col).cast("string"), F.lit(""))) != "")
    numbered = number_within_groups(work, [group_col], [k for k in keys if k != group_col] + ["_ord"],
                                    "group_row", "item_no")
    groups = numbered.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("group_count"), F.min("item_no").alias("first_item"))
    pages = F.ceil(F.col("group_count") / rows_per_page)
    w = Window.orderBy("first_item").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("first_page", F.coalesce(F.sum(pages).over(w), F.lit(0)) + 1)
    out = numbered.join(groups.select(group_col, "first_page"), group_col)
    page = F.col("first_page") + F.floor((F.col("group_row") - 1) / rows_per_page)
    return out.select(
        F.col(group_col).alias("group"), "item_no", page.cast("long").alias("page"),
        truncate_plain(F.col("type"), type_len).alias("type_disp"),
        ellipses(F.col("product_name"), product_len).alias("product_disp"),
        barcode_tail(F.col("package_barcode"), tail_len).alias("metrc_tail"),
        to_int(F.col("qty_on_hand")).alias("qty"), "distributor", "brand", "type", "store", "room")


def to_int(c: Column) -> Column:
    from stockspark.functions.parse import to_qty
    return to_qty(c)


def audit_index(listing: DataFrame) -> DataFrame:
    """Per group the item range, count and page range."""
    g = listing.groupBy("group").agg(
        F.min("item_no").alias("first_item"), F.max("item_no").alias("last_item"),
        F.count(F.lit(1)).alias("count"), F.min("page").alias("first_page"),
        F.max("page").alias("last_page"))

    def rng(a, b):
        return F.when(F.col(a) == F.col(b), F.col(a).cast("string")).otherwise(
            F.concat(F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string")))

    return g.select("group", rng("first_item", "last_item").alias("items"), "count",
                    rng("first_page", "last_page").alias("pages"), "first_item")


def sticker_listing(move_up: DataFrame, priority_rows: DataFrame, order: Column,
                    per_page: int = 30) -> DataFrame:
    """Priority rows first (product starred), then back stock, then the
    rest; item number and page; fields cut for print. Priority barcodes are
    removed from the move-up rows first (J11)."""
    from stockspark.functions.text import barcode_tail, ellipses
    prio_keys = priority_rows.select(F.trim("package_barcode").alias("_pb")).distinct()
    rest = move_up.join(prio_keys, F.trim(F.col("package_barcode")) == F.col("_pb"), "left_anti")
    cols = ["type", "product_name", "package_barcode", "room", "qty_on_hand"]
    prio = priority_rows.select(*cols, order.alias("_ord"), F.lit(0).alias("_rank"),
                                F.col("room").alias("_k1"), F.col("brand").alias("_k2"),
                                F.col("product_name").alias("_k3"))
    back = F.lower(F.trim(F.col("room"))) == "backstock"
    rest = rest.select(*cols, order.alias("_ord"), F.when(back, 1).otherwise(2).alias("_rank"),
                       F.col("type").alias("_k1"), F.col("brand").alias("_k2"),
                       F.col("product_name").alias("_k3"))
    both = prio.unionByName(rest)
    numbered = number_rows(both, ["_rank", "_k1", "_k2", "_k3", "_ord"], "item_no")
    product = F.when(F.col("_rank") == 0, F.concat(F.lit("⭐ "), F.col("product_name"))) \
               .otherwise(F.col("product_name"))
    return numbered.select(
        "item_no", (F.floor((F.col("item_no") - 1) / per_page) + 1).cast("long").alias("page"),
        ellipses(F.col("type"), 7).alias("type"), ellipses(product, 75).alias("product_name"),
        barcode_tail(F.col("package_barcode"), 6).alias("barcode_tail"),
        ellipses(F.col("room"), 12).alias("room"), F.col("qty_on_hand").alias("qty"),
        F.col("_rank").alias("block"))


def smart_sort_keys(df: DataFrame, col: str, descending: bool = False, group: str | None = None,
                    all_numeric: bool = False) -> list[Column]:
    """O2: numeric sort when values are numbers, else case-insensitive text.

    Column-level rule of the viewers: numeric order if any value parses
    (``all_numeric=False``) or only if every non-empty value parses
    (``all_numeric=True``, empty = -infinity); non-numeric values go last.
    The decision is a scalar subquery (no action on the driver).
    """
    v = F.trim(F.coalesce(F.col(col).cast("string"), F.lit("")))
    num = F.regexp_replace(v, ",", "").try_cast("double")
    if all_numeric:
        flag = df.select((F.count_if(num.isNotNull()) > 0)
                         & (F.count_if((v != "") & num.isNull()) == 0)).scalar()
        nkey = F.when(flag, F.when(v == "", F.lit(float("-inf"))).otherwise(num))
    else:
        flag = df.select(F.count_if(num.isNotNull()) > 0).scalar()
        nkey = F.when(flag, num)
    keys = [F.col(group)] if group else []
    return keys + [nkey.desc_nulls_last() if descending else nkey.asc_nulls_last(),
                   F.lower(v).desc() if descending else F.lower(v).asc()]


def smart_sort(df: DataFrame, col: str, descending: bool = False, group: str | None = None,
               all_numeric: bool = False) -> DataFrame:
    """O2: ``df`` in one global order by :func:`smart_sort_keys`."""
    return df.orderBy(*smart_sort_keys(df, col, descending, group, all_numeric))
