"""Corpus pipeline: five stages over ``documents``.

toxicity (documents that it rejects go) -> near-duplicates (one document of
each group stays) -> PII surrogates -> mixing to source weights -> SentencePiece
ids. Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before kept; every stage but the last returns the columns of documents.

Decisions name rows, not ids: toxicity is decided by the text, near-duplicates by
a number that each row gets for the stage.

Defined cases: rows with a null doc_id and rows that repeat one are documents like
any other; of a group of near-duplicates the smallest doc_id stays (null ids last, then
by the text and the other columns, so reruns keep the same content); null texts are empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm import mixing, pii, spm
from stockspark.llm.common import id_side, read, table
from stockspark.llm.minhash import near_duplicates
from stockspark.llm.queries import piece_model
from stockspark.llm.toxicity import text_key, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not mark."""
    scored = toxicity(docs, read(spark, sf_dir, "labels"), with_key=True)
    rejected = table(scored.where("predicted = 1").select("text_a", "text_b").distinct(), "pipeline-toxic")
    a, b = text_key()
    texts = id_side(rejected.select(F.col("text_a").alias("_text_a"), F.col("text_b").alias("_text_b")))
    return docs.join(texts, (a == F.col("_text_a")) & (b == F.col("_text_b")), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    # numbered once and written, so that every use sees the same numbers
    numbered = table(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                                 F.monotonically_increasing_id().alias("number")), "pipeline-numbered")
    found = near_duplicates(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")),
                            width=5, percent=80)
    # only rows of groups compete; the others are not looked at again
    grouped = found.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group"))
    shared = grouped.groupBy("group").count().where("count > 1").select("group")
    grouped = table(grouped.join(id_side(table(shared, "pipeline-groups")), "group"), "pipeline-copies")
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row"), F.col("number"))
    keys = numbered.select("number", order.alias("order")).join(grouped, "number")
    stays = keys.groupBy("group").agg(F.min("order").alias("o")).select(F.col("o.number").alias("number"))
    goes = table(grouped.select("number").join(id_side(table(stays, "pipeline-stays")), "number", "left_anti"),
                 "pipeline-rejected")
    kept = numbered.join(id_side(goes), "number", "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced by surrogates; n_chars follows the new text."""
    done = pii.replace_pii(docs)
    n_chars = F.when(F.col(done.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.take(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` ready for training, one row a copy."""
    ids = spm.encode(docs, piece_model())
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_private),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None      # nearest-example scores and piece ids are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
