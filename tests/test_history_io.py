"""Snapshot history JSON shapes (S5) and replay-safe appends."""

import json
import os
import tempfile

from stockspark.sources import history_io as hio

SNAPS = [
    {"timestamp": "2024-01-01T10:00:00", "file_name": "a.csv",
     "entries": [{"barcode": "X", "room": "vault", "qty": 5, "received_date": ""},
                 {"barcode": "Y", "room": "backstock", "qty": 2, "received_date": ""}]},
    {"timestamp": "2024-01-02T10:00:00", "file_name": "b.csv",
     "entries": [{"barcode": "X", "room": "sales floor", "qty": 4, "received_date": ""}]},
]


def _flat(df):
    return sorted((str(r.snapshot_date), r.snapshot_idx, r.entry_idx, r.barcode, r.room, r.qty)
                  for r in df.collect())


def test_dict_and_list_forms(spark):
    d = tempfile.mkdtemp(prefix="hist-", dir="/tmp")
    with open(os.path.join(d, "dict.json"), "w") as f:
        json.dump({"version": 1, "snapshots": SNAPS}, f, indent=2)
    l_dir = tempfile.mkdtemp(prefix="hist-", dir="/tmp")
    with open(os.path.join(l_dir, "list.json"), "w") as f:
        json.dump(SNAPS, f, indent=2)
    want = [("2024-01-01", 0, 0, "X", "vault", 5), ("2024-01-01", 0, 1, "Y", "backstock", 2),
            ("2024-01-02", 1, 0, "X", "sales floor", 4)]
    assert _flat(hio.read_snapshot_json(spark, os.path.join(d, "dict.json"), multiline=True)) == want
    got = hio.read_snapshot_json(spark, os.path.join(l_dir, "list.json"), multiline=True)
    assert [t[2:] for t in _flat(got)] == [t[2:] for t in want]


def test_replayed_append_does_not_duplicate(spark):
    from stockspark import fixtures as fx
    from .conftest import SF0001
    h = fx.snapshot_entry(spark, SF0001)
    path = os.path.join(tempfile.mkdtemp(prefix="snap-", dir="/tmp"), "h")
    hio.append_snapshots(h, path)
    hio.append_snapshots(h.where("snapshot_date = date'2024-01-05'"), path)
    assert hio.read_snapshots(spark, path).count() == h.count()


def test_purge_and_merge_stored_snapshots(spark, tmp_path):
    """Files of expired days are gone, the rest reads back equal from fewer files, also after a stopped merge."""
    import datetime as dt
    import os

    from stockspark.sources import history_io as hio
    from stockspark.sources import retention as rt
    path = str(tmp_path / "store")
    assert rt.purge_store(spark, path, 5, dt.date(2024, 1, 20)) == [] and rt.merge_store(spark, path) == 0
    rows = [(dt.date(2024, 1, d), f"A-{d}{k}", i, f"b{i}", "vault", i % 5) for d in range(1, 13) for k in "xy" for i in range(40)]
    df = spark.createDataFrame(rows, "snapshot_date date, import_id string, entry_idx long, barcode string, room string, qty int")
    hio.append_snapshots(df.repartition(4, "entry_idx"), path)
    want = sorted(map(tuple, df.where("snapshot_date >= '2024-01-06'").select(sorted(df.columns)).collect()))

    def back():
        return sorted(map(tuple, spark.read.parquet(path).select(sorted(df.columns)).collect()))

    def files():
        return [os.path.join(a, f) for a, _, c in os.walk(path) for f in c if f.endswith(".parquet")]
    assert rt.purge_store(spark, path, 0, dt.date(2024, 1, 12)) == []
    gone = rt.purge_store(spark, path, 6, dt.date(2024, 1, 12))
    assert gone == [dt.date(2024, 1, d) for d in range(1, 6)] and back() == want
    assert rt.purge_store(spark, path, 6, dt.date(2024, 1, 12)) == []
    many = len(files())
    # a merge that was stopped after the first folder had been moved away
    day = f"{path}/snapshot_date=2024-01-07"
    os.makedirs(f"{path}/_replaced/snapshot_date=2024-01-07")
    os.rename(f"{day}/import_id=A-7x", f"{path}/_replaced/snapshot_date=2024-01-07/import_id=A-7x")
    assert rt.merge_store(spark, path) == 14 and back() == want
    assert len(files()) == 14 < many and rt.merge_store(spark, path) == 0 and back() == want
    assert not any(n.startswith("_") and n != "_SUCCESS" for n in os.listdir(path))
    assert rt.purge_store_all(spark, path) == 7


def test_many_snapshots_in_a_document(spark, tmp_path):
    """Numbers stay distinct and in order beyond 4,096 snapshots a document, over several documents."""
    for k in range(2):
        snaps = [{"timestamp": "2024-01-01T10:00:00", "file_name": f"{k}-{i}", "entries": [{"barcode": f"{i}", "qty": 1}]}
                 for i in range(5000)]
        (tmp_path / f"{k}.json").write_text(json.dumps({"version": 1, "snapshots": snaps}))
    rows = hio.read_snapshot_json(spark, str(tmp_path), multiline=True).orderBy("snapshot_idx").collect()
    assert len({r.snapshot_idx for r in rows}) == 10000
    for k in range(2):
        assert [int(r.barcode) for r in rows if r.file_name.startswith(f"{k}-")] == list(range(5000))
