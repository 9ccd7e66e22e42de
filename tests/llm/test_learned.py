"""Language and toxicity: held-out quality, exact neighbours, defined cases."""

import random
import zlib

import numpy as np

from stockspark.llm import langid, toxicity
from stockspark.llm.queries import QUERIES

from ..conftest import SF001

DOCS = "doc_id long, text string, lang string, score string"


def test_held_out_language(spark):
    rows = (QUERIES["op3_language_mixture"](spark, SF001)
            .join(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang"), "doc_id")).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def mixed_docs():
    rnd = random.Random(3)
    a, b = ["alpha", "beta", "gamma", "delta"], ["ουκ", "εστιν", "και", "λογος"]
    rows = [(i, " ".join(rnd.choices(a if i % 2 else b, k=30)), "aa" if i % 2 else "bb", "x") for i in range(60)]
    return rows + [(100, None, "aa", ""), (101, "", None, ""), (102, "12 34 !? — …", "aa", ""), (103, "ΛΟΓΟΣ", None, ""),
                   (None, "alpha beta", "bb", ""), (104, "alpha beta " * 20 + "και λογος " * 60, None, ""),
                   (105, "alpha " * 30000, None, ""), (105, "alpha " * 30000, None, "")]


def test_language_cases(spark):
    docs = spark.createDataFrame(mixed_docs(), DOCS).repartition(3)
    rows = langid.identify(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(mixed_docs())
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == "bb" and by[105].lang_pred == "aa" and by[None].lang_pred == "aa"
    assert by[104].lang_pred == "bb" and set(by[104].mixture) == {"aa", "bb"} and abs(by[104].score - 0.75) < 0.05
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("doc_id < 9")
                                                 .selectExpr("doc_id", "text", "nullif(lang, '') as lang")).collect()} == {"und"}


def test_rows_do_not_depend_on_their_batch(spark):
    docs = spark.createDataFrame(mixed_docs()[:60], DOCS)
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify(docs.repartition(n)).collect()}
            for n in (1, 7))
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}


def test_held_out_toxicity(spark):
    rows = (QUERIES["op5_toxicity"](spark, SF001)
            .join(spark.read.parquet(f"{SF001}/labels.parquet").select("doc_id", "toxic"), "doc_id")).collect()
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert np.mean([r.predicted for r in clean]) < 0.02
    assert np.mean([r.predicted for r in toxic]) > 0.5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_cases(spark):
    rows = [(i, f"the quick brown fox {i}" + (" vile" if i % 3 == 0 else ""), "x", "y") for i in range(90)]
    rows += [(200, None, "", ""), (201, "", "", ""), (202, "VILE!", "", ""), (None, "vile", "", ""),
             (203, "calm " * 30000, "", ""), (202, "VILE!", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(5000, 1), (1, None)],
                                   "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[202].predicted == 1 and by[None].predicted == 1 and by[202].nearest
    assert not any(by[i].predicted for i in (200, 201, 203))
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 90)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_scores_do_not_depend_on_the_sample(spark, monkeypatch):
    """Votes of both classes stand for all labels of the class."""
    docs = spark.createDataFrame([(i, "calm day" + (" vile" if i % 2 == 0 or i % 16 == 1 else ""), "", "")
                                  for i in range(600)] + [(1000, "vile", "", ""), (1001, "other", "", "")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(600)], "doc_id long, toxic int")

    def scores():
        return {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).where("doc_id >= 1000").collect()}
    whole = scores()
    monkeypatch.setattr(toxicity, "PER_CLASS", 60)
    cut = scores()
    assert all(abs(whole[i] - cut[i]) < 0.1 for i in whole)
    examples = [((0,), (1,), 3, 1, 1), ((), (), 2, 1, 2)]
    index = toxicity.build_index(examples, np.ones(1), 4.0, 4.0)
    assert index.toxic.tolist() == [12.0] and index.clean.tolist() == [4.0]
    assert index.base == 5 / 7 and index.empty == (8 + 5 / 7) / 13


def test_nearest_are_exact():
    rnd = np.random.default_rng(1)
    examples = []
    for n in range(700):
        t = np.sort(rnd.choice(60, rnd.integers(1, 9), replace=False))
        examples.append((tuple(t), tuple(rnd.integers(1, 5, len(t))), int(n % 4 == 0), 1, n))
    index = toxicity.build_index(examples, rnd.uniform(1, 4, 60), 1.0)
    filled = sorted(examples, key=lambda e: (list(e[0]), list(e[1])))
    dense = np.zeros((len(filled), 60))
    for i, e in enumerate(filled):
        dense[i, list(e[0])] = index.unit(np.array(e[0]), np.array(e[1], dtype=float))
    for _ in range(100):
        t = np.sort(rnd.choice(60, rnd.integers(1, 9), replace=False))
        w = index.unit(t, rnd.integers(1, 5, len(t)).astype(float))
        q = np.zeros(60)
        q[t] = w
        _, cosine = index.nearest(t, w)
        want = np.sort(dense @ q)[::-1][:toxicity.NEAREST]
        assert np.allclose(cosine, want[:len(cosine)]) and (len(cosine) == toxicity.NEAREST or want[len(cosine)] == 0)


def test_terms_of_few_toxic_examples_are_found(spark, monkeypatch):
    """A term of a few toxic examples marks its documents also when equally many clean ones are sampled."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 160)
    words = [f"{a}{b}vile" for a in "abcde" for b in "abcdefgh"]
    rows = [(i, f"calm day {i % 7}" + (f" {words[i // 20 % 40]}" if i % 20 == 0 else ""), "", "") for i in range(3200)]
    docs = spark.createDataFrame(rows + [(10_000 + k, w, "", "") for k, w in enumerate(words)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(3200)], "doc_id long, toxic int")
    few = toxicity.toxicity(docs, labels).where("doc_id >= 10000").collect()
    seen = [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(0, 3200, 20) if i // 20 % 40 == k) for k in range(40)]
    assert len(few) == 40 and sum(n >= 2 for n in seen) >= 20
    assert all(r.predicted and r.nearest for r in few if seen[r.doc_id - 10_000] >= 2)


def plain_toxicity(rows, labels):
    """The whole query in plain Python (ASCII texts, no sampling, all examples as neighbours)."""
    import math
    import re
    from collections import Counter

    def tokens(text):
        out = Counter()
        for w in re.findall("[a-z]+", (text or "").lower()):
            out[w] += 1
            for n in (4, 5, 6, 7):
                if len(w) > n:
                    out[(n, w[:n])] += 1
        return out
    docs = {i: tokens(t) for i, t in rows}
    use = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2 and i in docs}
    toxic, clean = [i for i in use if use[i]], [i for i in use if not use[i]]
    n1, n0 = len(toxic), len(clean)
    in_toxic, in_clean = (Counter(t for i in some for t in docs[i]) for some in (toxic, clean))
    vocabulary = set()
    for t, x in in_toxic.items():
        c = in_clean[t]
        p1, p0, rate = (x + .5) / (n1 + 1), (c + .5) / (n0 + 1), (x + c + 1) / (n1 + n0 + 2)
        z = (p1 - p0) / math.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
        if x >= 2 and z >= 4 and p1 >= 4 * p0:
            vocabulary.add(t)
    for i in [i for i in toxic if not vocabulary & set(docs[i])]:
        w = {t: round(((1 + math.log(n)) * (math.log((1 + n0) / (1 + in_clean[t])) + 1)) ** 2, 9) for t, n in docs[i].items()}
        before, total = 0.0, sum(w.values())
        for level in sorted(set(w.values()), reverse=True):
            if before >= total / 2:
                break
            some = [t for t in w if w[t] == level]
            vocabulary.update(some)
            before += level * len(some)
    df = Counter(t for d in docs.values() for t in set(d) & vocabulary)
    vectors = {}
    for i, d in docs.items():
        v = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in d.items() if t in vocabulary}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / size for t, x in v.items()}
    base = n1 / (n1 + n0)
    out = {}
    for i, v in vectors.items():
        near = [(sum(x * vectors[e].get(t, 0) for t, x in v.items()), use[e]) for e in use if vectors[e]]
        vote = [0.0, 0.0]
        for cosine, y in near:
            if cosine > 0:
                vote[y] += math.exp((min(cosine, 1) - 1) / toxicity.SCALE)
        if not v:
            vote = [sum(1 for e in use if not vectors[e] and use[e] == y) for y in (0, 1)]
        out[i] = (vote[1] + base) / (vote[0] + vote[1] + 1)
    return out, vectors


def test_query_equals_plain_computation(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "NEAREST", 10_000)
    rnd = random.Random(9)
    usual = [f"{a}{b}" for a in ("river", "stone", "walking", "sun", "tree") for b in ("", "ly", "side", "ing")]
    rows = []
    for i in range(400):
        words = rnd.choices(usual, k=rnd.randint(1, 14))
        if i % 5 == 0:
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(["vile", "hateful", "VILENESS"]))
        rows.append((i, " ".join(words)))
    # toxic by label only: no marking word, once in the corpus, and a text without a learned copy that equals it
    odd = next(i for i in range(500, 600) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows += [(odd, "quietly peculiar utterance river stone"), (901, "quietly peculiar utterance river stone"),
             (902, "a peculiar tree"), (903, ""), (904, None), (905, "12 !")]
    labels = [(i, int(i % 5 == 0)) for i in range(400)] + [(odd, 1), (7000, 1)]
    want, vectors = plain_toxicity(rows, labels)
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    got = {r.doc_id: r for r in toxicity.toxicity(
        docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert vectors[odd] and not vectors[903]
    for i, r in got.items():
        assert abs(r.score - want[i]) < 1e-6, (i, r.score, want[i])
    assert got[901].predicted == 1 and got[901].nearest[0] == odd
    assert got[902].predicted == 0


def test_more_than_256_languages(spark):
    """Models shrink with the number of languages instead of ending the job."""
    rnd = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:03d}": ["".join(rnd.choices(letters, k=6)) for _ in range(5)] for k in range(300)}
    rows = [(n, " ".join(rnd.choices(w, k=25)), lang, "") for n, (lang, w) in enumerate(
        (x for _ in range(2) for x in own.items()))]
    rows += [(1000 + k, " ".join(rnd.choices(own[f"l{k:03d}"], k=25)), None, "") for k in range(0, 300, 10)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    learned = {lang for n, _, lang, _ in rows if lang and zlib.crc32(str(n).encode()) % 4 != 2}
    asked = [(n, f"l{n - 1000:03d}") for n, *_ in rows if n >= 1000]
    right = [got[n].lang_pred == lang for n, lang in asked if lang in learned]
    assert len(learned) > 256 and np.mean(right) > 0.95


def test_long_texts_in_pieces(spark, monkeypatch):
    """Pieces of any size give a long text the mixture that it has as a whole."""
    docs = mixed_docs()[:60] + [
        (200, "alpha beta " * 700 + "και λογος, " * 300, None, ""), (201, "12 34 " * 3000, None, ""),
        (202, "λ" * 9000 + " alpha", None, ""), (203, "Γamma" * 4000, None, "")]
    df = spark.createDataFrame(docs, DOCS).repartition(2)
    whole = {r.doc_id: r for r in langid.identify(df).collect()}
    for size in (300, 4096):
        monkeypatch.setattr(langid, "SLICE_BYTES", size)
        got = {r.doc_id: r for r in langid.identify(df).collect()}
        assert all(got[i].lang_pred == whole[i].lang_pred and abs(got[i].score - whole[i].score) < 2e-3 for i in whole)
    assert whole[200].lang_pred == "aa" and abs(whole[200].score - 0.7) < 0.05 and whole[201].lang_pred == "und"
