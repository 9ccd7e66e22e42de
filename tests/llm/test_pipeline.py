"""Stages keep their contracts; the ids equal the library's on the mixed texts."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from stockspark.llm.common import read, table

from ..conftest import SF0001


def test_stages(spark):
    docs = read(spark, SF0001, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = table(stage(spark, docs, SF0001), f"test-{name}")
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == columns
            ids = {r.doc_id for r in before.select("doc_id").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    counts = {n: d.count() for n, d in seen.items()}
    assert 180 <= counts["toxicity"] < 200 and counts["near_dedup"] < counts["toxicity"]
    assert counts["pii"] == counts["near_dedup"] and counts["mixing"] == counts["sentencepiece"] > 0
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, lib.encode(r.text)) for r in seen["mixing"].collect())
    assert sorted((r.doc_id, list(r.ids)) for r in seen["sentencepiece"].collect()) == want


def test_odd_rows(spark):
    rows = [(None, "text without an id " * 5, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0),
            (3, "repeated row of words here", "en", "t", 26), (3, "repeated row of words here", "en", "t", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        now = part
        for name, stage in corpus_pipeline.STAGES:
            now = table(stage(spark, now, SF0001), f"odd-{name}")
            if name == "near_dedup" and part is docs:
                assert now.where("doc_id = 3").count() == 1
        assert now.columns == ["doc_id", "n_tokens", "ids"]


def test_decisions_name_rows_not_ids(spark):
    """A toxic text goes and a copy goes whatever its id; a clean row that shares an id with either stays."""
    labels = {r.doc_id for r in read(spark, SF0001, "labels").where("toxic = 1").collect()}
    docs = read(spark, SF0001, "documents")
    scored = corpus_pipeline.toxicity(docs, read(spark, SF0001, "labels"))
    toxic = [r.doc_id for r in scored.where("predicted = 1").orderBy("doc_id").limit(2).collect()]
    bad = {r.doc_id: r for r in docs.where(docs.doc_id.isin(toxic)).collect()}
    assert labels and len(bad) == 2
    one, two = (bad[i] for i in toxic)
    clean = " ".join(f"plain{i}" for i in range(60))
    copy = " ".join(f"other{i}" for i in range(60))
    rows = [(None, one.text, "x", "s", 1), (one.doc_id, clean, "x", "s", 2), (None, copy, "x", "s", 3),
            (None, copy, "y", "s", 4), (two.doc_id, copy + " end", "z", "s", 5), (two.doc_id, "an unlike text of few words", "z", "s", 6)]
    # ids that no document has, so that the planted rows bring no labels
    odd = spark.createDataFrame([tuple(r) for r in docs.collect()] + [
        (None if i is None else 10 ** 9 + i, *r) for i, *r in rows], docs.schema)
    kept = table(corpus_pipeline.reject_toxic(spark, odd, SF0001), "rows-toxicity")
    left = {(r.doc_id, r.text) for r in kept.collect()}
    assert (None, one.text) not in left and (one.doc_id, one.text) not in left
    assert {(None if i is None else 10 ** 9 + i, t) for i, t, *_ in rows[1:]} <= left
    last = corpus_pipeline.drop_near_duplicates(spark, kept, SF0001).collect()
    names = [(r.doc_id, r.text, r.n_chars) for r in last if r.n_chars is not None and r.n_chars < 10]
    assert sorted(names, key=str) == sorted([
        (10 ** 9 + one.doc_id, clean, 2), (10 ** 9 + two.doc_id, copy + " end", 5),
        (10 ** 9 + two.doc_id, "an unlike text of few words", 6)], key=str)
