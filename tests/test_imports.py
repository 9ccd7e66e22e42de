"""Import identity: two stores, two imports a day, replays, mixed JSON forms."""

import json

from pyspark.sql import functions as F

from stockspark import fixtures as fx
from stockspark.operators import velocity as vl
from stockspark.sources import history_io as hio

from .conftest import SF0001


def test_two_imports_of_one_day(spark):
    rows = [("2024-01-01 11:00:00", 1, "b", "a", 5), ("2024-01-01 11:00:00", 2, "b", "b", 5),
            ("2024-01-01 23:00:00", 1, "b", "a", 5), ("2024-01-01 23:00:00", 2, "b", "b", 5)]
    h = spark.createDataFrame(rows, "t string, entry_idx long, barcode string, room string, qty int")
    h = h.withColumn("snapshot_ts", F.to_timestamp("t"))
    got = vl.barcode_history(h, snap="snapshot_ts").first()
    assert got.room_changes == 3 and got.qty_unchanged_streak == 3


def test_replay_and_second_store(spark, tmp_path):
    h = fx.import_entry(spark, SF0001)
    path = str(tmp_path / "history")
    for part in (h.where("store = 'A'"), h.where("store = 'B'"), h.where("store = 'A'")):
        hio.append_snapshots(part, path)
    back = hio.read_snapshots(spark, path)
    assert back.count() == h.count()
    assert back.select("store", "import_id").distinct().count() == h.select("store", "import_id").distinct().count()


def test_mixed_json_forms(spark, tmp_path):
    entry = {"barcode": "b", "room": "r", "qty": 1}
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text(json.dumps(
        {"version": 1, "snapshots": [{"timestamp": "2024-01-01T10:00:00", "file_name": "x", "entries": [entry]}]}))
    (tmp_path / "h" / "b.json").write_text(json.dumps(
        [{"timestamp": "not a time", "file_name": "y", "entries": [entry, entry]}]))
    rows = hio.read_snapshot_json(spark, str(tmp_path / "h"), multiline=True).collect()
    assert sorted((r.file_name, r.snapshot_ts is None) for r in rows) == [("x", False), ("y", True), ("y", True)]
    assert hio.read_snapshot_json(spark, str(tmp_path / "absent")).count() == 0
