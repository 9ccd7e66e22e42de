"""Golden cases from the worked examples of the inventory tool."""

import datetime as dt

from pyspark.sql import functions as F

from stockspark.functions import text as tx
from stockspark.functions.numeric import ratio_text
from stockspark.operators import compare as cp
from stockspark.operators import expiring as ex
from stockspark.operators import restock as mu
from stockspark.sources.ingest import barcode_like

INV = ("ord int, type string, brand string, product_name string, package_barcode string, room string, "
       "qty_on_hand int, distributor string, store string, size string, received_date date, "
       "wholesale_cost double, unit_price double")


def _inv(spark, rows):
    return spark.createDataFrame(rows, INV)


def _row(ord_, room, qty, barcode="SKU-123", brand="B", product="P", type_="Flower", dist=None):
    return (ord_, type_, brand, product, barcode, room, qty, dist, "A", "1g", None, 1.0, 2.0)


def test_split_package_merge(spark):
    df = _inv(spark, [_row(1, "Vault", 5, dist=None), _row(2, "Backstock", 3, dist="D2"),
                      _row(3, "Vault", 2, dist="D3")])
    out = {(r.room, r.qty_on_hand, r.distributor)
           for r in mu.split_packages(df, F.col("ord")).collect()}
    # first non-null distributor of the Vault group is the third row's
    assert out == {("Vault", 7, "D3"), ("Backstock", 3, "D2")}


def test_anti_join_drops_product_on_floor(spark):
    df = _inv(spark, [_row(1, "Sales Floor", 1, "X1", "Cookies", "Blue Dream 3.5g"),
                      _row(2, "Backstock", 4, "X2", "Cookies", "Blue Dream 3.5g"),
                      _row(3, "Backstock", 2, "X3", "Cookies", "Purple Haze 1g")])
    names = [r.product_name for r in mu.move_up(df, ["Backstock"]).collect()]
    assert names == ["Purple Haze 1g"]


def test_diag_invariant(spark):
    df = _inv(spark, [_row(1, "Sales Floor", 1, "X1", "C", "A"), _row(2, "Backstock", 4, "X2", "C", "A"),
                      _row(3, "Backstock", 2, "X3", "C", "B"), _row(4, "SF", 2, "X4", "C", "B"),
                      _row(5, "Backstock", 2, "X5", "C", "Z", type_="Accessories")])
    d = mu.move_up_diag(df, ["Backstock"], aliases={"SF": "Sales Floor"}).first()
    assert d.total_loaded == 5 and d.after_type == 4
    assert d.candidate_pool == d.removed_as_on_sf + d.move_up
    assert (d.candidate_pool, d.removed_as_on_sf, d.move_up) == (2, 2, 0)


def test_imbalance_guard_and_ratio_text(spark):
    cmp = spark.createDataFrame(
        [("b", "p1", "T", "r", 2, "T", "r", 1), ("b", "p2", "T", "r", 9, "T", "r", 4),
         ("b", "p3", "T", "r", 49, "T", "r", 20)],
        "brand string, product_name string, type_a string, rooms_a string, qty_a long, "
        "type_b string, rooms_b string, qty_b long")
    rows = {r.product_name: r.ratio for r in cp.imbalances(cmp).collect()}
    assert "p1" not in rows                      # 2 vs 1 is not flagged
    assert rows == {"p2": "2.2x", "p3": "2.5x"}  # Python rounding of 2.25 and 2.45


def test_ratio_text_matches_python(spark):
    pairs = [(a, b) for a in range(1, 120) for b in range(1, 60)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", ratio_text(F.col("a"), F.col("b")).alias("t"))
    assert all(r.t == f"{r.a / r.b:.1f}x" for r in df.collect())


def test_barcode_by_content(spark):
    df = spark.createDataFrame([("1A4060300007B9E000012345",), ("1A40-6030 0007B9E0",), ("Metric 123",)], "v string")
    assert [r.ok for r in df.select(barcode_like(F.col("v")).alias("ok")).collect()] == [True, True, False]


def test_buckets(spark):
    def labels(days):
        return [r.bucket for r in ex.bucket_table(spark, days).orderBy("pos").collect()]
    base = ["0–7 days", "8–14 days", "15–30 days"]
    assert labels(30) == base
    assert labels(75) == [*base, "31–60 days", "61–75 days"]
    assert labels(31) == [*base, "31 days"]
    assert labels(5) == base[:1]
    at = spark.sql("select explode(array(0, 7, 8, 14, 15, 30, 31, 60, 61)) d").select(ex.bucket_position(F.col("d")))
    assert [r[0] for r in at.collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_dirty_values_end_no_job(spark):
    from stockspark.functions import parse
    df = spark.createDataFrame([(v,) for v in ("nan", "inf", "-inf", "99999999999999999999", "20240131", "45322",
                                               "2024-01-31 10:00:00.123", "1/5/2024 3:04 PM", "2024-01-31T10:00:00Z",
                                               "Jan 5 2024", "", None)], "v string")
    rows = df.select("v", parse.parse_expiry(F.col("v")).cast("string").alias("e"),
                     parse.to_money(F.col("v")).alias("m"), parse.parse_number(F.col("v")).alias("n"),
                     parse.to_qty(F.col("v")).alias("q")).collect()
    got = {r.v: (r.e, r.m, r.n, r.q) for r in rows}
    assert got["nan"] == (None, 0.0, None, 0) and got["99999999999999999999"][0] is None and got["inf"][0] is None
    assert got["20240131"][0] == "2024-01-31" and got["45322"][0] == "2024-01-31"
    assert got["2024-01-31 10:00:00.123"][0] == "2024-01-31" == got["2024-01-31T10:00:00Z"][0]
    assert got["1/5/2024 3:04 PM"][0] == "2024-01-05" == got["Jan 5 2024"][0]
    assert got[""] == (None, 0.0, None, 0) == got[None]


def test_alias_duplicates_and_selections(spark):
    from stockspark.functions.rooms import normalize_rooms_df
    df = spark.createDataFrame([("SF",), (" sf",), ("Vault",)], "room string")
    aliases = {"SF": "First", "sf ": "Last"}
    table = spark.createDataFrame([("SF", "First", 0), ("sf ", "Last", 1)], "from_room string, to_room string, pos int")
    for a in (aliases, table):
        assert sorted(r.room for r in normalize_rooms_df(df, a).collect()) == ["Last", "Last", "Vault"]
    inv = spark.createDataFrame([("p1", "A", "b1", "Vault", "T"), ("p2", "B", "b2", "Vault", "T")],
                                "product_name string, brand string, package_barcode string, room string, type string")
    brands = spark.createDataFrame([("A",), ("A",)], "brand string")
    for sel in (["A"], brands):
        d = mu.move_up_diag(inv, ["Vault"], brands=sel).first()
        assert (d.after_dropna, d.after_brand, d.move_up) == (2, 1, 1)


def test_rooms_fold(spark):
    df = _inv(spark, [_row(i, r, 1, f"X{i}", "B", "P") for i, r in enumerate(["Vault 2", "Vault", "", "B"])])
    assert cp.product_map(df, F.col("ord")).first().rooms == "Vault 2, B"


def test_text_helpers(spark):
    df = spark.createDataFrame([("1A4-000123-XYZ", "abcdefghij", 1234.5)], "b string, s string, v double")
    r = df.select(tx.barcode_tail(F.col("b"), 6).alias("t"), tx.barcode_tail(F.col("b"), 6, True).alias("d"),
                  tx.ellipses(F.col("s"), 7).alias("e"), tx.truncate_text(F.col("s"), 5).alias("u"),
                  tx.format_currency(F.col("v")).alias("c")).first()
    assert (r.t, r.d, r.e, r.u, r.c) == ("23-XYZ", "000123", "abcd...", "abcd…", "$1,234.50")


def test_expiry_inclusive_cutoff(spark):
    df = spark.createDataFrame([(dt.date(2001, 1, 31),), (dt.date(2001, 2, 1),), (None,)], "expiration_date date") \
        .select(F.lit("x").alias("category"), F.lit("").alias("metrc6"), F.lit("p").alias("product_name"),
                F.lit("r").alias("location"), "expiration_date")
    out = ex.expiring_items(df, dt.date(2001, 1, 1), 30, include_expired=True, include_missing=False)
    assert [r.days_to_expire for r in out.collect()] == [30]


def test_py_round_matches_python(spark):
    from stockspark.functions.numeric import py_round
    vals = [2.675, 1.0005, 0.125, 0.375, 2.5, -2.5, 0.0175, 1.005, -0.045] + \
        [k / 1000 + 0.0005 for k in range(-500, 500)] + [d / 29 for d in range(-60, 60)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for k in (2, 3):
        rows = df.select("x", py_round(F.col("x"), k).alias("r")).collect()
        assert all(r.r == round(r.x, k) for r in rows)
