"""Raw-file ingest and streaming against batch results."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.sources import ingest as ig

from .conftest import SF0001

COLS = ["type", "brand", "product_name", "package_barcode", "room", "qty_on_hand", "distributor",
        "store", "size", "received_date", "wholesale_cost", "unit_price"]


def test_ingest_round_trip(spark):
    from __spark_entry__ import queries
    got = queries()["ingest_raw"](spark, SF0001)
    want = fx.inventory(spark, SF0001).select(*COLS)
    assert got.count() == 6000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_missing_required_column_raises(spark):
    d = tempfile.mkdtemp(prefix="ingest-", dir="/tmp")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("Title line\nBrand,Product Name,METRC Code,Room\nB,P,1A4000000000000000000001,Vault\n")
    with pytest.raises(ValueError, match="Missing required column"):
        ig.ingest_raw(spark, d).collect()


def test_header_after_title_lines(spark):
    d = tempfile.mkdtemp(prefix="ingest-", dir="/tmp")
    with open(os.path.join(d, "a.tsv"), "w") as f:
        f.write("Store Report\n\nType\tBrand\tProduct\tTracking\tLocation\tQuantity\n"
                "Flower\tB\tP 1\t1A4000000000000000000001\tVault\t3\n"
                "\t\t\t\t\t3\n")
    out = ig.ingest_raw(spark, d).collect()
    assert [(r.product_name, r.package_barcode, r.room, r.qty_on_hand) for r in out] == \
        [("P 1", "1A4000000000000000000001", "Vault", 3)]


def test_splits_and_broadcast_do_not_matter(spark, tmp_path, monkeypatch):
    """The same rows, line numbers included, whatever the split size and the joins; a file of many splits."""
    head = "Report, of the store\n\nType,Brand,Product Name,METRC Code,Room,Qty\n"
    for f in range(3):
        (tmp_path / f"f{f}.csv").write_text(head + "".join(
            f'Flower,B{i % 7},"P {i}{chr(10) + "second line" if f == 1 and i % 50 == 0 else ""}",'
            f"1A400000000000000{f}{i:06d},Vault,{i}\n" for i in range(4000)))
    want = None
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold",
                                             "spark.sql.shuffle.partitions")}
    try:
        for size, limit, parts in (("64k", "-1", "16"), ("128m", "10m", "4"), ("7k", "10m", "4")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            monkeypatch.setattr(ig, "BROADCAST_SPLITS", 0 if limit == "-1" else 20_000)
            lines = sorted((r.file, r._ord, r.value) for r in ig.read_lines(spark, str(tmp_path)).collect())
            rows = sorted((r.file, r._ord, r.product_name, r.qty_on_hand) for r in ig.ingest_raw(spark, str(tmp_path)).collect())
            want = want or (lines, rows)
            assert (lines, rows) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 12000 and [x[1] for x in lines if x[0].endswith("f0.csv")] == list(range(4003))
    assert sorted(x[1] for x in rows if x[0].endswith("f2.csv")) == list(range(3, 4003))


def test_files_that_cannot_be_mapped_are_named(spark, tmp_path):
    good = "\ufeffType,Brand,Product Name,METRC Code,Room,Qty\nF,B,P,1A4000000000000000000001,Vault,2\n"
    (tmp_path / "a.csv").write_text(good, encoding="utf-8")
    (tmp_path / "b.csv").write_text("Brand,Product Name,METRC Code\nB,P,1A4000000000000000000001\n")
    (tmp_path / "c.csv").write_text("just one line")
    got = ig.ingest_files(ig.scan_text(spark, str(tmp_path)))
    assert [(r.type, r.qty_on_hand, r._ord) for r in got.rows.collect()] == [("F", 2, 1)]
    assert {r.file[-5:]: r.reason for r in got.rejected.collect()} == {
        "b.csv": "Missing required column(s) after mapping: type, room, qty_on_hand",
        "c.csv": "Missing required column(s) after mapping: type, brand, product_name, package_barcode, room, qty_on_hand"}


def test_stream_names_the_files_it_leaves_out(spark, tmp_path):
    from stockspark.streaming import jobs
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.csv").write_text(
        "Type,Brand,Product Name,METRC Code,Room,Qty\nF,B,P,1A4000000000000000000001,Vault,2\n")
    (tmp_path / "src" / "b.csv").write_text("Brand,Product Name,METRC Code\nB,P,1A4000000000000000000001\n")
    out = str(tmp_path / "out")
    for ck in ("ck1", "ck2"):                                   # the second run replays the batch
        jobs.stream_ingest(spark, str(tmp_path / "src"), out, str(tmp_path / ck)).awaitTermination()
    assert [(r.product_name, r.qty_on_hand) for r in spark.read.parquet(out).collect()] == [("P", 2)]
    left = spark.read.parquet(out + "_rejected").collect()
    assert [(r.file[-5:], r.reason) for r in left] == [
        ("b.csv", "Missing required column(s) after mapping: type, room, qty_on_hand")]


def test_overrides_of_one_file(spark, tmp_path):
    body = "Kind,Maker,Label,Code,Place,N,When\nF,B,P,,Vault,2,1/2/2024\n,,,,,9,\n"
    for f in "abcdef":
        (tmp_path / f"{f}.csv").write_text(body)
    path = {r.file[-5]: r.file for r in ig.scan_text(spark, str(tmp_path)).select("file").distinct().collect()}
    full = {"type": "Kind", "brand": " maker ", "product_name": "LABEL", "package_barcode": "Code", "room": "Place",
            "qty_on_hand": "N", "received_date": "When", "size": None}
    maps = {"a": full, "b": {**full, "room": ""}, "c": {**full, "size": "Code"}, "d": {**full, "colour": "When"},
            "e": {**full, "brand": "Nowhere"}, "none.csv": full}
    rows = [(path.get(f, f), t, s) for f, m in maps.items() for t, s in m.items()]
    over = spark.createDataFrame(rows, "file string, target string, source string")
    got = ig.ingest_files(ig.scan_text(spark, str(tmp_path)), over)
    # the summary line stays and the date stays text on this path
    assert sorted((r.file[-5:], r.brand or "", r.qty_on_hand, r.received_date, r.received_text)
                  for r in got.rows.collect()) == [("a.csv", "", 9, None, None), ("a.csv", "B", 2, None, "1/2/2024")]
    reasons = {r.file[-5:]: r.reason for r in got.rejected.collect()}
    assert reasons.pop("f.csv").startswith("Missing required")
    assert reasons == {"b.csv": "no source for: room", "c.csv": "source column used for more than one target: code",
                       "d.csv": "source column used for more than one target: when; unknown target: colour",
                       "e.csv": "no such column: nowhere"}


def test_stream_velocity_equals_batch(spark):
    from __spark_entry__ import queries
    from stockspark.operators import velocity as vl
    got = queries()["stream_velocity"](spark, SF0001)
    h = fx.snapshot_entry(spark, SF0001)
    want = vl.barcode_history(h).select("barcode", "n_entries", "room_changes",
                                        F.col("first_qty").cast("long").alias("first_qty"),
                                        "qty_unchanged_streak")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _snapshots(days, rows):
    import datetime as dt
    return [(b, dt.date(2024, 1, d), i, r, q) for i, (b, d, r, q) in enumerate(rows) if d in days]


def test_state_late_entries_and_expiry(spark, tmp_path):
    """Late entries go to the side table and are folded in for their barcodes only; unseen barcodes leave the state."""
    from stockspark.operators import velocity as vl
    from stockspark.streaming import jobs
    rows = [("a", d, "vault" if d % 2 else "floor", 5) for d in range(1, 30)]
    rows += [("b", 1, "vault", 9), ("b", 2, "vault", 9), ("c", 2, "vault", 1), ("c", 28, "floor", 1), ("", 3, "x", 1)]
    src, sums, late, out, ck1, ck2 = (str(tmp_path / x) for x in ("src", "sums", "late", "out", "ck1", "ck2"))

    def feed(part):
        spark.createDataFrame(part, jobs.ENTRIES).write.mode("append").parquet(src)
        jobs.stream_summaries(spark, src, sums, late, ck1).awaitTermination()
        jobs.stream_velocity(spark, sums, out, ck2, expire_days=20).awaitTermination()
    held = {4, 5}
    feed(_snapshots(set(range(1, 11)) - held, rows))
    feed(_snapshots(set(range(11, 25)) | {4}, rows))            # day 4 comes after day 10
    feed(_snapshots(set(range(25, 30)) | {5}, rows))
    feed([("d", __import__("datetime").date(2024, 1, 30), 900, "vault", 2)])
    history = spark.read.schema(jobs.ENTRIES).parquet(src)
    updates, late_rows = spark.read.parquet(out), spark.read.parquet(late)
    assert {(r.barcode, r.snapshot_date.day) for r in late_rows.collect()} == {("a", 4), ("a", 5)}
    expired = {r.barcode for r in updates.where("expired").collect()}
    assert expired == {"b", "c"} or expired == {"b"}           # c is unseen from day 2 to 28: a new state after day 22
    want = {r.barcode: tuple(r) for r in vl.barcode_history(history).select(
        "barcode", "n_entries", "room_changes", "first_qty", "qty_unchanged_streak").collect()}
    got = {r.barcode: tuple(r)[:4] + (r.qty_unchanged_streak,) for r in jobs.running_state(
        updates, late_rows, history).collect()}
    assert got["a"] == want["a"] and got["d"] == want["d"] and "b" not in got
    # the summary half alone: nothing of a batch is lost or doubled
    assert spark.read.parquet(sums).agg(F.sum("n_s")).first()[0] + late_rows.count() == history.where("barcode <> ''").count()


def test_summaries_merge_in_any_cut(spark):
    """Velocity from stored summaries equals velocity from the entries, whatever the segments."""
    import random

    from stockspark.operators import velocity as vl
    from stockspark.streaming import jobs
    rnd = random.Random(3)
    rows = [(f"u{rnd.randrange(6)}", d, rnd.choice("xy"), rnd.randrange(3)) for d in range(1, 25) for _ in range(12)]
    h = spark.createDataFrame(_snapshots(set(range(1, 25)), rows), jobs.ENTRIES)
    cur = h.where("snapshot_date = '2024-01-24'")
    want = sorted(map(tuple, vl.velocity_metrics(cur, h, "2024-01-31").collect()))
    for size in (1, 2, 7, 10 ** 6):
        s = vl.snapshot_summaries(h, size)
        assert sorted(map(tuple, vl.velocity_metrics(cur, s, "2024-01-31", summarised=True).collect())) == want


def test_quotes_inside_unquoted_cells(spark, tmp_path):
    """A lone inch mark is text; line breaks inside quoted cells still are one record."""
    head = "Type,Brand,Product Name,METRC Code,Room,Qty\n"

    def row(i, name):
        return f"Flower,B,{name},1A40000000000000000{i:05d},Vault,{i}\n"
    for f, odd in (("a", '12" glass'), ("b", '"two\n""lines"", and 12"" more\nend"'), ("c", '"never closed')):
        (tmp_path / f"{f}.csv").write_text(head + "".join(
            row(i, odd if i == 3 else '7" bowl' if f == "b" and i % 10 == 5 else f"P {i}") for i in range(1, 301)))
    rows = ig.ingest_raw(spark, str(tmp_path)).collect()
    by = {(r.file[-5], int(r.package_barcode[-5:])): r for r in rows if r.package_barcode}
    for f in "ab":
        assert {i for g, i in by if g == f} == set(range(1, 301))
        assert all(by[f, i].qty_on_hand == i for i in range(1, 301))
    assert by["a", 3].product_name == '12" glass' and by["b", 15].product_name == '7" bowl'
    assert by["b", 3].product_name == 'two\n"lines", and 12" more\nend'
    assert {i for g, i in by if g == "c"} >= set(range(4, 301))


def test_quote_states_across_blocks(spark):
    """The state is the same whatever the blocks; compared with a reader of single characters."""
    import csv
    import io
    import random
    rnd = random.Random(5)
    for _ in range(3):
        text = "".join(rnd.choices(['"', '"', ",", "\n", "a", "b", '""'], k=120)) + '\nend,"x"\n,,'
        got = []
        for size in (3, 1000):
            rows = [(v, "f.csv", i // size, i, ",") for i, v in enumerate(text.split("\n"))]
            df = spark.createDataFrame(rows, "value string, file string, _block long, _ord long, delim string")
            found = ig.stitched(df)
            got.append([r.value for r in (df if found is None else found[1]).orderBy("_ord").collect()])
        want, left = [], text.split("\n")
        for n in range(len(left)):
            if not left:
                break
            for k in range(1, len(left) + 1):
                # closed when the reader takes what follows as a new record
                if len(list(csv.reader(io.StringIO("\n".join(left[:k]) + "\nQ")))) > 1:
                    want.append("\n".join(left[:k]))
                    left = left[k:]
                    break
            else:
                want += left
                left = []
        assert got[1] == want
        assert got[0] == want
