"""Steps whose cost must not grow faster than their input, and the results they keep."""

import datetime as dt

from pyspark.sql import functions as F

from stockspark.functions.parse import parse_received_date


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_received_date_prepares_its_text_once(spark):
    day = dt.date(2024, 3, 7)
    same = ["03/07/2024 01:02:03 PM", "''2024-03-07", "2024-03-07 10:11:12.5", "2024-03-07T10:11:12Z", "3/7/2024",
            "3/7/2024 9:05", "3/7/24", "03-07-2024", "2024/03/07", "7 Mar 2024", "Mar 7, 2024", "March 7, 2024",
            "7-Mar-2024", "20240307", "2024-03-07 10:11:12 +05:00"]
    bad = ["", "nan", "3/7", "2024-13-01", "10:11", "7/Mar/2024", None]
    df = spark.createDataFrame([(t,) for t in same + bad], "t string").repartition(2)
    got = df.select("t", parse_received_date(F.col("t")).alias("d"))
    assert {(r.t, r.d) for r in got.collect()} == {(t, day) for t in same} | {(t, None) for t in bad}
    assert _plan(got).count("regexp_replace") <= 2


def test_exports_read_their_rows_twice(spark, tmp_path):
    from stockspark import fixtures as fx
    from stockspark.sources.raw_export import write_expiring_exports, write_raw_exports
    from .conftest import SF0001
    inv = fx.inventory(spark, SF0001).limit(300).localCheckpoint()
    for write, most in ((write_raw_exports, 2), (write_expiring_exports, 2)):
        calls = spark.sparkContext.accumulator(0)

        @F.udf("boolean")
        def seen(_, calls=calls):
            calls.add(1)
            return True
        write(inv.where(seen("ord_2")), str(tmp_path / write.__name__))
        assert 0 < calls.value <= most * 300


def test_records_are_split_once(spark, tmp_path):
    from stockspark.sources import ingest as ig
    (tmp_path / "a.csv").write_text('Type,Brand,Product,Metrc Tag,Room,Qty,Store\n'
                                    'Flower,B,"P, ""1""",1A4000000000000001,Vault,2,A\n'
                                    'Flower,,P2,1A4000000000000002,"",3,A\n\nTOTAL,,,,,5,\n')
    raw = ig.scan_text(spark, str(tmp_path)).withColumn("_modified", F.lit(dt.datetime(2024, 1, 2)))
    got = ig.ingest_files(raw, identify=lambda f, m: {"store": F.lit("Z"), "import_id": F.lit("i"), "import_ts": m}).rows
    assert _plan(got).count("regexp_extract_all") <= len(ig.DELIMITERS)
    assert {(r.brand, r.product_name, r.room, r.qty_on_hand, r.store, r.import_id, r.import_ts) for r in got.collect()} == {
        ("B", 'P, "1"', "Vault", 2, "Z", "i", dt.datetime(2024, 1, 2)),
        (None, "P2", None, 3, "Z", "i", dt.datetime(2024, 1, 2))}


def test_numbered_rows_are_a_written_table(spark):
    from stockspark.plans import QUERIES
    from .conftest import SF0001
    plan = _plan(QUERIES["smart_sort"](spark, SF0001))
    assert "l_orderkey" not in plan and "LogicalRDD" not in plan and "ExistingRDD" not in plan


def test_import_log_joins_the_tables_once(spark):
    from stockspark.plans import QUERIES
    from .conftest import SF0001
    assert "l_orderkey" not in _plan(QUERIES["import_timeline"](spark, SF0001))


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_split_packages_shuffles_its_rows_once(spark):
    from stockspark.operators import restock as mu
    rows = [(" T1", "Vault", "A", "B", "P", 1, None, "s1", 1), ("T1", "Vault ", "A", "B", "P", 2, "d", None, 2),
            ("T1", "Vault", "A", "B", "P", 4, "e", "s2", 0), ("T2", "backstock", "Z", None, "P", 8, "f", "s3", 3),
            ("T0", "Vault", "A", "B", "P", 16, None, None, -1), ("", "Vault", "A", "B", "P", 32, "g", "s4", 4)]
    df = spark.createDataFrame(rows, "package_barcode string, room string, type string, brand string, "
                                     "product_name string, qty_on_hand int, distributor string, store string, ord int").repartition(3)
    for sort, most in ((True, 1), (False, 1)):
        got = mu.split_packages(df.localCheckpoint(), F.col("ord"), ["distributor", "store"], sort)
        assert _exchanges(got) == most
        want = [("T2", "backstock", "Z", "", "P", 8, "f", "s3"), ("T0", "Vault", "A", "B", "P", 16, None, None),
                ("T1", "Vault", "A", "B", "P", 7, "e", "s2")]
        rows = [tuple(r) for r in got.collect()]
        assert (rows if sort else sorted(rows)) == (want if sort else sorted(want))


def test_seen_barcodes_keep_their_timer():
    from pyspark.sql import Row

    from stockspark.streaming.jobs import RunningVelocity

    class Held:
        value, calls = None, []
        def get(self): self.calls.append("get"); return self.value
        def exists(self): self.calls.append("exists"); return self.value is not None
        def update(self, v): self.calls.append("update"); self.value = v
        def clear(self): self.value = None

    class Handle:
        timers, calls = [], []
        def getValueState(self, *_): return held
        def registerTimer(self, t): self.calls.append("register"); self.timers.append(t)
        def deleteTimer(self, t): self.calls.append("delete"); self.timers.remove(t)
        def listTimers(self): self.calls.append("list"); return list(self.timers)

    class Clock:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms

    held, handle, p = Held(), Handle(), RunningVelocity(10)
    p.init(handle)

    def day(d, room, qty):
        return Row(barcode="a", seg=d, snapshot_date=dt.date(2024, 1, d), n_s=1, changes_s=0, first_room_s=room,
                   last_room_s=room, first_qty_s=qty, last_qty_s=qty, tail_s=1)

    def ms(d):
        return int(dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc).timestamp() * 1000)
    list(p.handleInputRows(("a",), iter([day(2, "x", 5), day(1, "y", 7)]), Clock(0)))
    out, = p.handleInputRows(("a",), iter([day(5, "x", 5)]), Clock(0))
    assert out.asDict() == {"barcode": "a", "n_entries": 3, "room_changes": 1, "first_qty": 7, "last_qty": 5,
                            "qty_unchanged_streak": 1, "last_snapshot": dt.date(2024, 1, 5), "expired": False}
    assert held.calls == ["get", "update"] * 2 and handle.calls == ["register"] and handle.timers == [ms(12)]
    # the first timer goes off: the barcode has been seen since, and stays
    assert list(p.handleExpiredTimer(("a",), Clock(ms(13)), None)) == [] and handle.timers[-1] == ms(15) and held.value
    gone, = p.handleExpiredTimer(("a",), Clock(ms(16)), None)
    assert gone.expired and gone.n_entries == 3 and held.value is None


def test_comparison_shuffles_twice_and_works_out_ratios_once(spark):
    from stockspark.operators import compare as cp
    rows = [("A", "B", "P", "t1", "Vault", 9, 1), ("A", " B", "P", "t2", "Back", 1, 0), ("B", "B", "P", "t3", "Vault", 4, 2),
            ("B", None, "Q", "t4", "Floor", 3, 3), ("A", "B", "R", "t5", "Floor", 2, 4), ("C", "B", "S", "t6", "Floor", 2, 5)]
    df = spark.createDataFrame(rows, "store string, brand string, product_name string, type string, room string, "
                                     "qty_on_hand int, ord int").repartition(3).localCheckpoint()
    cmp = cp.store_comparison(cp.product_map(df, F.col("ord")))
    assert _exchanges(cmp) == 2
    assert {tuple(r) for r in cmp.collect()} == {("B", "P", "t2", "Back, Vault", 10, "t3", "Vault", 4),
                                                 ("", "Q", None, None, None, "t4", "Floor", 3),
                                                 ("B", "R", "t5", "Floor", 2, None, None, None)}
    recs = cp.transfer_recs(cmp)
    assert _plan(recs).count("_tenths") > 1
    assert {(r.product_name, r.priority, r.qty, r.reason) for r in recs.collect()} == {
        ("P", "Low", 3, "Imbalanced (2.5x)"), ("Q", "High", 3, "Not at A"), ("R", "Medium", 2, "Not at B")}


def _on_disk(*tops):
    import os
    return sorted(os.path.join(d, f) for top in tops for d, _, names in os.walk(top) for f in names)


def _inventory(spark, orders):
    """``orders`` rows of the inventory's columns, one per order."""
    o = F.col("id")
    text = {"type": "Flower", "room": "Vault", "distributor": "D", "size": "1"}
    return spark.range(orders).select(
        *[o.alias(f"ord_{k}") for k in range(1, 7)], *[F.lit(v).alias(c) for c, v in text.items()],
        F.concat(F.lit("B"), o % 7).alias("brand"), F.concat(F.lit('P "'), o, F.lit('"')).alias("product_name"),
        F.concat(F.lit("1A4"), F.lpad(o.cast("string"), 21, "0")).alias("package_barcode"),
        (o % 50).cast("int").alias("qty_on_hand"), F.when(o % 2 == 0, "A").otherwise("B").alias("store"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (o % 300).cast("int")).alias("received_date"),
        (o * 0.5).alias("wholesale_cost"), (o * 1.5).alias("unit_price"))


def test_packed_exports_in_slices_read_back_the_same(spark, tmp_path):
    """Written in slices and gzipped or at once and plain: the same lines, numbers and rows; lock files stay out."""
    from stockspark.sources import ingest as ig
    from stockspark.sources.raw_export import write_raw_exports
    inv = _inventory(spark, 900)
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    write_raw_exports(inv, plain, 50)
    write_raw_exports(inv, packed, 50, compression="gzip", slice_rows=200)
    names = [f for f in _on_disk(packed) if "part-" in f and not f.endswith(".crc")]
    assert len(names) == 18 and all(f.endswith(".txt.gz") for f in names)

    def lines(path):
        return sorted((r.k, r._ord, r.value) for r in ig.read_lines(spark, path).withColumn(
            "k", F.regexp_extract("file", r"file_key=(\d+)", 1)).collect())
    assert lines(plain) == lines(packed) and len(lines(packed)) == 900 + 18 * 2 + sum(k % 4 for k in range(18))
    columns = ["product_name", "package_barcode", "qty_on_hand", "received_date", "unit_price", "_ord"]
    want = sorted(map(tuple, ig.ingest_raw(spark, plain).select(columns).collect()))
    assert sorted(map(tuple, ig.ingest_raw(spark, packed).select(columns).collect())) == want and len(want) == 900
    taken = spark.createDataFrame([("a/~$b.csv.gz",), ("a/b.csv.gz",), ("a/b.pdf.gz",), ("b.TSV",)], "f string")
    assert [r[0] for r in taken.select(ig.supported_file(F.col("f"))).collect()] == [False, True, False, True]


def test_written_tables_leave_no_shuffle_and_the_session_as_it_was(spark):
    import time

    from stockspark.session import WRITING, written_once
    before = {k: spark.conf.get(k, None) for k in WRITING}

    def shuffles():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(b.toString().startswith("shuffle_") for b in [s.apply(i) for s in [manager.getAllBlocks()]
                                                                 for i in range(s.size())])
    start = shuffles()
    got = written_once(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "no-shuffle")
    for _ in range(50):
        if shuffles() <= start:
            break
        time.sleep(0.1)
    assert shuffles() <= start and got.count() == 10
    assert {k: spark.conf.get(k, None) for k in WRITING} == before


def test_stream_batches_are_bounded_and_leave_no_scratch(spark, tmp_path, monkeypatch):
    from stockspark.session import checkpoint_dir
    from stockspark.sources.raw_export import write_raw_exports
    from stockspark.streaming import jobs
    src, out, snaps = (str(tmp_path / x) for x in ("src", "out", "snaps"))
    write_raw_exports(_inventory(spark, 120), src, 20, compression="gzip")
    monkeypatch.setattr(jobs, "BATCH_BYTES", 1200)
    before = _on_disk(checkpoint_dir(spark))
    jobs.stream_ingest(spark, src, out, str(tmp_path / "ck"), snapshots_target=snaps).awaitTermination()
    assert set(_on_disk(checkpoint_dir(spark))) <= set(before)
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() > 1 and got.select("import_id").distinct().count() == 6
    assert got.count() == got.select("package_barcode").distinct().count() == 120 == spark.read.parquet(snaps).count()


def test_imports_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Few partitions a task: written side by side, so rows are not sorted by import; the session is as before."""
    from pyspark.sql import DataFrameWriter

    from stockspark.sources.raw_export import _field
    from stockspark.streaming import jobs
    name, seen, plain = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    before = spark.conf.get(name, None)

    def spied(self, path, *a, **b):
        seen.append(int(spark.conf.get(name)))
        return plain(self, path, *a, **b)
    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    df = spark.range(700).select("id", F.concat(F.lit("i"), F.col("id") % 7).alias("import_id")).repartition(2)
    for _ in range(2):                                          # the second run replaces
        jobs._replace(df, str(tmp_path / "t"), "import_id")
    assert all(n > 1 for n in seen) and len(seen) == 2 and spark.conf.get(name, None) == before
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == sorted(map(tuple, df.collect()))
    quoted = _field(F.col("t"), True)
    assert "regexp" not in str(quoted)
    assert spark.createDataFrame([('a"b""',), (None,)], "t string").select(quoted).collect() == [('"a""b"""""',), ('""',)]
