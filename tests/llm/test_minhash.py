"""Components against brute force on full shingle sets."""

import random
import re

import numpy as np

from stockspark.llm import minhash

SCHEMA = "doc_id long, text string, hashes string"


def brute(rows, width, percent=80):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    ids = sorted(x for x in sets if x is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    out = []
    for i, many in sets.items():
        out += [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for s in many]
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def corpus():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = rnd.choices(words, k=rnd.randint(1, 120))
        for _ in range(rnd.randint(1, 7)):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 25))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows) * 2, " ".join(t), "x"))
    rows += [(900, None, "a"), (901, "", "b"), (902, " \n\t", None), (903, "one two", "c"), (904, "ONE\x0btwo", "c"),
             (905, "one two three", "c"), (None, "one two", "d"), (None, None, "d"), (906, "long " * 30000, "e"),
             (907, "long " * 29000 + "x", "e"), (908, "Éa b c d e f", "f"), (909, "éa b c d e f", "f")]
    rows += [(1000 + i, "many exact copies of one text that is long enough", "g") for i in range(300)]
    rows += [(1000, "many exact copies of one text that is long enough", "g"), (0, "a second text of document zero", "h")]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for width in (4, 5):
        got = sorted((tuple(r) for r in minhash.near_duplicates(df, width).collect()), key=key)
        assert got == sorted(brute(rows, width), key=key)


def test_hot_group_loses_no_link(spark, monkeypatch):
    """A group of near copies just around the limit: chains that no star centre meets; small blocks, so cells are split."""
    rnd = random.Random(7)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(260):
        t = list(base)
        for k in rnd.sample(range(160), rnd.randint(2, 9)):
            t[k] = f"x{rnd.randrange(6)}"
        rows.append((i, " ".join(t), ""))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sorted(brute(rows, 4), key=key)
    assert len({r[2] for r in want}) > 5                          # several components and loners
    for block in (16, 512):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert sorted((tuple(r) for r in minhash.near_duplicates(df, 4).collect()), key=key) == want


def test_bitmaps_never_rule_out_a_link():
    rnd = np.random.default_rng(5)
    for n in (1, 3, 40, 3000):
        a = np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64) * np.uint64(2))
        keep = a[: max(1, int(n * 0.9))]
        bits = np.stack([np.frombuffer(minhash.parity_bits(x), dtype=np.uint64) for x in (a, keep)])
        got = minhash._block_pairs(np.array([5, 3]), np.array([len(a), len(keep)]), np.array([5, 3]),
                                   np.array([False, False]), bits, 80)
        linked = 100 * len(keep) >= 80 * len(a)
        assert [x.tolist() for x in got] == ([[3], [5]] if linked else [[], []]) or not linked


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_densified_signatures():
    """Equal sets, also tiny ones, have equal full signatures; collisions follow the similarity."""
    rnd = np.random.default_rng(0)
    one = np.array([7], dtype=np.uint64)
    assert (minhash.signature(one) == 7).all()
    errors = []
    for _ in range(60):
        a = np.unique(rnd.integers(0, 2 ** 63, 300).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[:240], rnd.integers(0, 2 ** 63, 60).astype(np.uint64) * np.uint64(2)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - true)
    assert abs(np.mean(errors)) < 0.02


def test_star_edges_are_linear(spark):
    """A bucket of n documents proposes n - 1 pairs in a turn, not n squared."""
    text = " ".join(f"common{i}" for i in range(200))
    rows = [(i, f"{text} tail{i}", "") for i in range(400)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
