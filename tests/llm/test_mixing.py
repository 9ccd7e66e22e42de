"""Targets by repeated resharing, thresholds by brute force over sorted hashes."""

import hashlib
import re

import pytest

from stockspark.llm import mixing

ROWS = ([(i, "w " * (i % 37 + 1), f"s{i % 7}" if i % 7 else None, "x") for i in range(400)]
        + [(1000, "one  huge\tdocument\n" * 4000, "s2", None), (1001, None, "s3", ""), (1002, "", "zz", ""),
           (None, "no id here", "s1", ""), (7, "w " * 8, "s1", "x"), (7, "w " * 8, "s1", "x"),
           (1003, "éa b\x0bc", "s1", "y")])
SCHEMA = "doc_id long, text string, source string, hash string"


def reshared(sizes):
    """Share the budget by weight again and again until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, target = mixing.SHARE * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > mixing.MOST * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = mixing.MOST * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes = {}
    for r, n in zip(rows, size):
        sizes[r[2]] = sizes.get(r[2], 0) + n
    target = reshared(sizes)
    out = []
    h = [int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) for r in rows]
    for s in sizes:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, got, extra = target[s] - whole * sizes[s], 0, set()
        for x in sorted({h[i] for i in mine}):
            n = sum(size[i] for i in mine if h[i] == x)
            if got + n > rest:
                if got + n - rest < rest - got:
                    extra.add(x)
                break
            got += n
            extra.add(x)
        out += [(rows[i][0], size[i], sizes[s], target[s], size[i] * (whole + (h[i] in extra))) for i in mine]
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2], r[4])


def test_equals_brute_force(spark):
    got = sorted((tuple(r) for r in mixing.mix(spark.createDataFrame(ROWS, SCHEMA)).collect()), key=key)
    want = sorted(brute(ROWS), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[4] == w[4]
        assert g[3] == pytest.approx(w[3], rel=1e-12)
        assert g[4] <= 2 * g[1]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 0}, {"a": 5},
                                   {"a": 1, "b": 1, "c": 1, "d": 100, None: 7}, {str(i): i * i for i in range(30)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_take_repeats_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in taken.collect())
    assert words == sum(r.taken for r in mixing.mix(docs).collect())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0 and mixing.take(docs).count() == 0
