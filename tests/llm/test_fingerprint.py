"""Neighbours, edits and likeness against a plain computation."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from stockspark.llm import fingerprint as fp


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    out = []
    for i, (doc_id, _, _) in enumerate(order):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        q = len(t) // 4
        e = t[:len(t) - q] + n[:q]
        s = fp.fingerprints(pa.array([t, e, n], pa.large_string()))
        near = fp.likeness(s[[0, 0]], s[[1, 2]])
        out.append((doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), s[0].astype(">u4").tobytes().hex(),
                    s[1].astype(">u4").tobytes().hex(), float(near[0]), float(near[1])))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[3])


def test_equals_plain(spark):
    rnd = np.random.default_rng(5)
    words = ["alpha", "Beta", "γάμμα", "delta,", "ß", "x"]
    rows = [(int(i * 3 - 50), " ".join(rnd.choice(words, rnd.integers(0, 40))), "e") for i in range(300)]
    rows += [(7000, None, "a"), (7001, "", "b"), (None, "no id", "c"), (7002, "longest word " * 9000, "d"),
             (7003, "same", "x"), (7003, "same", "x"), (7003, " \n\t ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    got = sorted((tuple(r) for r in fp.fingerprint(docs).collect()), key=key)
    assert got == sorted(plain(rows), key=key)


def test_one_row_and_empty(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    assert [tuple(r) for r in fp.fingerprint(one).collect()] == plain([(5, "a b c d e f g h", None)])
    assert fp.fingerprint(one.limit(0)).count() == 0


def test_collision_rate_is_generalised_jaccard():
    rnd = np.random.default_rng(3)
    texts, truth = [], []
    for _ in range(150):
        a = Counter({f"w{i}": int(rnd.integers(1, 9)) for i in range(40)})
        b = Counter({w: int(max(0, n + rnd.integers(-3, 4))) for w, n in a.items()})
        b.update({f"v{i}": 2 for i in range(int(rnd.integers(0, 30)))})
        texts += [" ".join(x.elements()) for x in (a, b)]
        keys = set(a) | set(b)
        truth.append(sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys))
    s = fp.fingerprints(pa.array(texts, pa.large_string()))
    error = fp.likeness(s[::2], s[1::2]) - np.array(truth)
    assert abs(error.mean()) < 0.015 and np.sqrt((error ** 2).mean()) < 0.08
