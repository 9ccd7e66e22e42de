"""Hard negatives against brute force: ties, copies, odd rows, many shards, early stops."""

import math

import numpy as np

from stockspark.llm import negatives as neg


def plain(rows, scale=256, every=50):
    ok = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in ok:
        if i % every == 0:
            anchors[(i, lab)] = min(v, anchors.get((i, lab), v))
    out = []
    for (i, lab), v in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, x == lab) for j, x, w in ok if j != i and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2]][:5]:
            hits = [(j, -s) for s, j, same in scored if not same and 50 * -ps <= 100 * -s <= 95 * -ps][:3]
            out += [(i, p, r + 1, j, -ps, s) for r, (j, s) in enumerate(hits)]
    return sorted(out)


def rows_of():
    rnd = np.random.default_rng(11)
    centre = rnd.normal(0, 0.5, (3, 8))
    rows = [(int(i), int(rnd.integers(0, 4)), [float(x) for x in rnd.normal(0, 0.3, 8) + centre[i % 3]]) for i in range(700)]
    rows += [(1000 + i, 2, [0.5] * 8) for i in range(300)]                    # copies: ties go to smaller ids
    rows += [(2000 + i, 1, [0.375] * 8) for i in range(120)]
    rows += [(5000, None, [1.0] * 8), (5050, 1, None), (5100, 1, [1.0, None] + [1.0] * 6), (5150, 1, [math.nan] * 8),
             (5200, 1, [math.inf] * 8), (5250, 1, []), (None, 1, [1.0] * 8), (5300, 1, [0.0] * 8), (5350, 1, [1.0, 2.0]),
             (5351, 1, [3.0, 1.0]), (5352, 2, [1.0, 1.0]), (5400, 7, [0.1] * 8), (100, rows[100][1], rows[100][2])]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "e", 1) for r in rows],
                               "vec_id long, label int, embedding array<double>, score string, rank int")
    want = plain(rows)
    for shard, depth in ((100, 4), (100_000, 64)):
        monkeypatch.setattr(neg, "SHARD_ROWS", shard)
        monkeypatch.setattr(neg, "DEPTH", depth)
        got = sorted(tuple(r) for r in neg.hard_negatives(df.repartition(5)).collect())
        assert got == want and len(want) > 100
    assert neg.hard_negatives(df.limit(0)).count() == 0


def test_threshold_stops_early_and_exact(monkeypatch):
    monkeypatch.setattr(neg, "DEPTH", 8)
    rnd = np.random.default_rng(6)
    rows = rnd.integers(-9, 9, (4000, 3))
    ids, labels = rnd.permutation(4000).astype(np.int64), rnd.integers(0, 2, 4000)
    lists = neg.Lists(ids, labels, rows)
    for q in ([7, -5, 3], [0, 2, 0], [0, 0, 0], [-1, -1, -8]):
        q = np.array(q)
        s = rows @ q
        windows = [(-50, 60), (0, 0), (5, 4), (10 ** 6, 10 ** 7)]
        for same in (True, False):
            got = lists.search(int(ids[17]), 1, q, 3, same, windows)
            for w, (low, high) in enumerate(windows):
                want = sorted((-int(s[i]), int(ids[i])) for i in range(4000)
                              if ids[i] != ids[17] and (labels[i] == 1) == same and low <= s[i] <= high)[:3]
                assert [(-x, i) for v, i, x in got if v == w] == want


def test_huge_components_stay_exact():
    rows = np.array([[2 ** 30, 1], [2 ** 30, 2], [1, 1]], dtype=np.int64)
    lists = neg.Lists(np.array([1, 2, 3]), np.array([0, 0, 0]), rows)
    q = np.array([2 ** 30, 1], dtype=np.int64)
    got = lists.search(9, 0, q, 2, True, [(-2 ** 62, 2 ** 62)])
    assert got == [(0, 2, 2 ** 60 + 2), (0, 1, 2 ** 60 + 1)]
