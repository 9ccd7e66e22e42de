"""Ball-tree search against brute force; the fixity audit against planted damage."""

import math

import numpy as np
from pyspark.sql import functions as F

from stockspark.llm import balltree, warc


def test_tree_search_is_exact():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(-300, 300, (900, 8))
    rows[100:500] = rows[100]                                    # one very common vector
    ids = rnd.permutation(900).astype(np.int64)
    tree = balltree.BallTree(ids, rows)
    for q in (0, 3, 100, 700):
        want = sorted(((-int(rows[i] @ rows[q]), int(ids[i])) for i in range(900) if ids[i] != ids[q]))[:10]
        got = sorted((-s, d) for s, d in tree.search(int(ids[q]), rows[q], 10, None))
        assert got == want
        floor = (-want[4][0], want[4][1])
        assert sorted((-s, d) for s, d in tree.search(int(ids[q]), rows[q], 10, floor)) == want[:4]


def test_top_k_cases(spark, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD_ROWS", 60)
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(0, 1, 6)], 1, "e") for i in range(400)]
    rows += [(1000 + i, [0.5] * 6, 2, "e") for i in range(300)]  # copies
    rows += [(2000, None, 0, ""), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, ""), (2200, [math.nan] * 6, 0, ""),
             (2300, [math.inf] * 6, 0, ""), (2400, [], 0, ""), (None, [9.0] * 6, 0, ""), (2500, [1.0, 2.0], 0, ""),
             (2501, [3.0, 4.0], 0, ""), (200, rows[200][1], 1, "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i, v in {i: v for i, v in ok if i % 100 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:10]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert {tuple(r) for r in balltree.top_k(df.repartition(4)).collect()} == want
    assert balltree.top_k(df.limit(0)).count() == 0


def test_audit_finds_planted_damage(spark):
    pages = spark.createDataFrame(
        [(i, f"http://x/{i}", f"<p>{'é' * (i % 50)}{i}</p>", "e") for i in range(3000)]
        + [(5000, None, None, ""), (5001, "u", "z" * 300000, ""), (7, "dup", "dup", ""), (7, "dup", "dup", ""),
           (None, "n", "n", "")], "page_id long, url string, html string, file string")
    records = warc.archive(pages.drop("file"))
    assert warc.audit(records, records).count() == 0
    second = (records.where("not page_id <=> 2999").withColumn("record", F.when(F.col("page_id") == 1500, F.lit("cut"))
              .when(F.col("page_id") == 5001, F.concat(F.lit("X"), F.substr("record", F.lit(2), F.length("record"))))
              .otherwise(F.col("record"))))
    second = second.unionByName(records.where("page_id = 3").withColumn("page_id", F.lit(9000).cast("long")))
    got = {(r.page_id, r.damage) for r in warc.audit(records, second).collect()}
    assert got == {(2999, "missing"), (1500, "resized"), (5001, "altered"), (9000, "extra")}
    assert warc.audit(records.limit(0), records.limit(0)).count() == 0
