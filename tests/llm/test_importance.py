"""Buckets, gains, weights, scores and ranks against a plain computation with zlib and re."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from stockspark.llm import importance as imp
from stockspark.llm.flat import text_slices

from ..conftest import SF0001

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), Counter(zlib.crc32(r.encode()) % 10000 for r in runs)


def plain(rows, target):
    found = [(d, *plain_features(t)) for d, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    sn, tn = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * sn / ((s[b] + 1) * tn))) for b in range(10000)]
    out = []
    for d, words, f in found:
        weight = sum(gain[b] * n for b, n in f.items())
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, sum(f.values()), weight, score, None, words])
    may = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(may[:5 * len(may) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_equals_plain(spark):
    rnd = np.random.default_rng(8)
    words = ["alpha", "Beta7", "γάμμα", "delta,", "ß", "x-y", "Ünder", " wide", "a\x7fb", "I've"]
    rows = [(int(i * 7 - 90), " ".join(rnd.choice(words, rnd.integers(0, 60))), 1) for i in range(400)]
    rows += [(9000, None, 0), (9001, "", 0), (9002, "?! --\n", 0), (None, "one two three " * 20, 0),
             (9003, "same text here " * 9, 0), (9003, "same text here " * 9, 0), (9004, "q" * 3000 + " tail", 0),
             (9005, "long words of a very long text " * 30000, 0)]
    target = ["alpha delta alpha", "Beta7 beta7 ß", None, "", "same text here"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(6)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = imp.importance(docs, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain([r[:2] for r in rows], target)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 5


def test_whole_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF0001}/{t}.parquet") for t in ("documents", "benchmark"))
    from stockspark.llm.queries import QUERIES
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    got = QUERIES["op13_importance_resampling"](spark, SF0001)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_chunks_do_not_matter(monkeypatch):
    import pyarrow as pa
    texts = pa.array(["a b c d e f g a b c", "", "x", "y z", None, "a b"], pa.string())

    def totals():
        n = np.zeros(10000, dtype=np.int64)
        for _, _, data, offsets in text_slices(texts):
            for _, bucket in imp.features(data, offsets):
                n += np.bincount(bucket, minlength=10000)
        return n.tolist()
    whole = totals()
    for chunk in (1, 2, 3, 5):
        monkeypatch.setattr(imp, "CHUNK", chunk)
        assert totals() == whole
    want = Counter()
    for t in texts.to_pylist():
        want.update(plain_features(t)[1])
    assert {b: n for b, n in enumerate(whole) if n} == dict(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert imp.importance(docs.limit(0), docs).count() == 0
    assert [tuple(r)[:3] for r in imp.importance(docs, docs.limit(0)).collect()] == [
        (1, 3, 3 * math.floor(1000 * math.log(10003 / 20000)))]
