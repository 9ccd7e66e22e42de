"""Invariants over the fixture tables."""

from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.operators import compare as cp
from stockspark.operators import listing as ls
from stockspark.operators import restock as mu
from stockspark.operators import velocity as vl
from stockspark.plans.restock_queries import CANDIDATE_ROOMS

from .conftest import SF0001


def test_fixture_counts(spark):
    inv = fx.inventory(spark, SF0001)
    assert inv.count() == 6000
    assert mu.move_up(inv, CANDIDATE_ROOMS, aliases=fx.ROOM_ALIASES).count() == 596
    d = mu.move_up_diag(inv, CANDIDATE_ROOMS, aliases=fx.ROOM_ALIASES).first()
    assert d.candidate_pool == 1376 and d.candidate_pool == d.removed_as_on_sf + d.move_up


def test_store_partition(spark):
    pm = cp.product_map(fx.inventory(spark, SF0001), fx.ord_key())
    cmp = cp.store_comparison(pm)
    a, b = cp.only_in(cmp, "a").count(), cp.only_in(cmp, "b").count()
    both = cp.both_stores(cmp).count()
    assert (a, b, both) == (345, 349, 1205)
    assert a + b + both == cmp.count()


def test_split_keeps_qty(spark):
    inv = fx.inventory(spark, SF0001)
    merged = mu.split_packages(inv, fx.ord_key())
    total = inv.where(F.trim("package_barcode") != "").agg(F.sum("qty_on_hand")).first()[0]
    assert merged.agg(F.sum("qty_on_hand")).first()[0] == total


def test_velocity_labels_partition(spark):
    h = fx.snapshot_entry(spark, SF0001)
    vel = vl.velocity_metrics(fx.current_items(spark, SF0001, h), h, fx.VELOCITY_AS_OF)
    counts = {r.velocity_label: r["count"] for r in vel.groupBy("velocity_label").count().collect()}
    assert sum(counts.values()) == 15
    assert [counts.get(k, 0) for k in ["New", "Fast", "Moderate", "Slow", "Stale", "Sold Out"]] == [0, 8, 4, 0, 2, 1]


def test_number_rows_is_gapless(spark):
    inv = fx.inventory(spark, SF0001)
    pos = [r.pos for r in ls.number_rows(inv.select(*fx.ORD_COLS), fx.ORD_COLS, "pos").collect()]
    assert sorted(pos) == list(range(1, inv.count() + 1))


def test_audit_numbers_are_1_to_n(spark):
    inv = fx.inventory(spark, SF0001)
    out = ls.audit_listing(inv, fx.ord_key(), "distributor_type_size_product")
    items = sorted(r.item_no for r in out.select("item_no").collect())
    assert items == list(range(1, 6001))
    per = out.groupBy("group").agg(F.min("page").alias("p0"), F.max("page").alias("p1"),
                                   F.count(F.lit(1)).alias("n")).collect()
    assert all(r.p1 - r.p0 + 1 == -(-r.n // 35) for r in per)


def test_velocity_segments_do_not_change_results(spark):
    """Tiny segments (2 entries) split every (barcode, snapshot) group; the
    cross-segment combine must give the same per-barcode history."""
    h = fx.snapshot_entry(spark, SF0001)
    big = vl.barcode_history(h)
    small = vl.barcode_history(h, segment_rows=2)
    assert big.exceptAll(small).count() == 0 and small.exceptAll(big).count() == 0
