"""Document fingerprints by consistent weighted sampling (operator 10).

A text is its lower-cased words weighted by their counts. For each of
``SAMPLES`` samples a word draws, from its own hash, two Gamma(2, 1) values r, c
and a uniform b; with weight w it takes level ``t = floor(ln w / r + b)`` and
score ``ln c - r * (t - b) - r``. The word with the lowest score and its level
are the sample. Two texts draw the same sample with the chance of their
generalised Jaccard similarity (sum of minimum over sum of maximum weights), so
the share of equal samples estimates it; equal texts have equal fingerprints.

The edited text needs the next document in order of doc_id. Rows are dealt into
ranges of doc_id and sorted within; the first row of each range also goes to
the range before it (the very first one to the last range). So texts are
shuffled once, and a task streams through its rows with one row carried over.

Defined cases: null text is empty text. Texts without words have the
fingerprint of zeros; they are like each other (1) and unlike all others (0).
Null doc_ids come after all others; rows that repeat a doc_id are ordered by
text. A single row is its own next document. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.flat import U64, RangeHash, lower_ascii, mix64, spans, text_slices

SAMPLES = 64
FINGERPRINT_BYTES = 4 << 20 # of texts whose words are drawn for together
RANGES_A_PARTITION = 2     # ranges of doc_id for each shuffle partition
TASK_BYTES = 8 << 20       # of texts a task
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")

_LOG = np.log(np.arange(1, 4097, dtype=np.float64)).astype(np.float32)


def _bits(terms: np.ndarray, stream: int) -> np.ndarray:
    """64 hashed bits for each term and sample."""
    k = np.arange(1, SAMPLES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
    return mix64(terms[:, None] ^ (k + U64(stream * 0x5851F42D4C957F2D)))


def _uniform(bits: np.ndarray, shift: int, width: int) -> np.ndarray:
    """Uniform values in (0, 1] from ``width`` of the bits."""
    part = (bits >> U64(shift)) & U64((1 << width) - 1)
    return (part.astype(np.uint32).astype(np.float32) + np.float32(1)) * np.float32(2.0 ** -width)


def draws(terms: np.ndarray) -> np.ndarray:
    """``r, ln c - r, b`` of each term and sample, terms x 3 x SAMPLES."""
    out = np.empty((len(terms), 3, SAMPLES), dtype=np.float32)
    for i in range(0, len(terms), 512):           # small enough for the processor's cache
        part = out[i:i + 512]
        one, two = _bits(terms[i:i + 512], 1), _bits(terms[i:i + 512], 2)
        r = -np.log(_uniform(one, 0, 21) * _uniform(one, 21, 21))
        np.maximum(r, np.float32(1e-6), out=part[:, 0])
        c = -np.log(_uniform(two, 0, 24) * _uniform(two, 24, 24))
        np.subtract(np.log(np.maximum(c, np.float32(1e-30))), part[:, 0], out=part[:, 1])
        part[:, 2] = _uniform(one, 42, 22)
    return out


def log_weight(count: np.ndarray) -> np.ndarray:
    out = _LOG[np.minimum(count, 4096) - 1]
    big = count > 4096
    if big.any():
        out[big] = np.log(count[big]).astype(np.float32)
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Samples (texts x SAMPLES, uint32) of a column; all 0 for texts without words."""
    out = np.zeros((len(texts), SAMPLES), dtype=np.uint32)
    column = np.arange(SAMPLES)
    for first, end, data, offsets in text_slices(texts, FINGERPRINT_BYTES):
        data = lower_ascii(data)
        starts, ends, doc = spans(data, offsets)
        terms, number = np.unique(RangeHash(data)(starts, ends), return_inverse=True)
        drawn = draws(terms)
        key, count = np.unique(doc * max(1, len(terms)) + number, return_counts=True)
        of_doc, term, weight = key // max(1, len(terms)), key % max(1, len(terms)), log_weight(count)
        cut = np.searchsorted(of_doc, np.arange(end - first + 1))
        word = np.zeros((end - first, SAMPLES), dtype=np.uint64)
        at_level = np.zeros((end - first, SAMPLES), dtype=np.float32)
        filled = np.flatnonzero(cut[1:] > cut[:-1])
        for i in filled:
            t = term[cut[i]:cut[i + 1]]
            mine = drawn[t]
            r, b = mine[:, 0], mine[:, 2]
            level = weight[cut[i]:cut[i + 1], None] / r
            level += b
            np.floor(level, out=level)
            score = level - b
            score *= r
            np.subtract(mine[:, 1], score, out=score)
            best = score.argmin(axis=0)
            word[i], at_level[i] = terms[t[best]], level[best, column]
        sample = mix64(word[filled] ^ mix64(at_level[filled].astype(np.int64).view(np.uint64)))
        out[first + filled] = np.maximum(sample >> U64(32), U64(1)).astype(np.uint32)
    return out


def _hex(samples: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in samples.astype(">u4")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples; texts without words are like each other only."""
    empty_a, empty_b = ~a.any(axis=1), ~b.any(axis=1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), (a == b).mean(axis=1))


def edit(text: str, following: str) -> str:
    """The last quarter replaced by as many code points of the next document's start."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def _rows(ids: list, texts: list[str], number: int) -> pa.RecordBatch:
    """Results of the first ``number`` rows; each row's next document follows it."""
    edited = [edit(texts[i], texts[i + 1]) for i in range(number)]
    samples = fingerprints(pa.array(texts[:number + 1] + edited, pa.large_string()))
    own, other, changed = samples[:number], samples[1:number + 1], samples[number + 1:]
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:number], pa.int64()), pa.array([len(t) for t in texts[:number]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited], pa.string()),
        pa.array(_hex(own), pa.string()), pa.array(_hex(changed), pa.string()),
        pa.array(likeness(own, changed), pa.float64()), pa.array(likeness(own, other), pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order; a range ends with rows of the next one (``ahead``)."""
    part, done = None, True                 # current range; whether its first row ahead was used
    run_ids: list = []
    run_texts: list[str] = []
    for batch in batches:
        parts, ahead = batch.column("part").to_pylist(), batch.column("ahead").to_pylist()
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for i in range(len(ids)):
            if parts[i] != part:
                part, done, run_ids, run_texts = parts[i], False, [], []
            if done:
                continue
            run_ids.append(ids[i])
            run_texts.append(texts[i] or "")
            if ahead[i]:
                if len(run_ids) > 1:
                    yield _rows(run_ids, run_texts, len(run_ids) - 1)
                done, run_ids, run_texts = True, [], []
        if len(run_ids) > 1:
            yield _rows(run_ids, run_texts, len(run_ids) - 1)
            run_ids, run_texts = run_ids[-1:], run_texts[-1:]      # its next row comes with the next batch


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs(doc_id, text)``, of its edited text, and their likeness."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    # tasks follow the bytes of the texts, so a task's share does not grow with the corpus
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ranges = partitions * RANGES_A_PARTITION
    bounds = np.unique(np.array(ids.where("doc_id is not null").approxQuantile(
        "doc_id", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)), dtype=np.int64))

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, doc_id.fillna(0).to_numpy(dtype=np.int64), side="right")
        return pd.Series(np.where(doc_id.isna(), len(bounds), at).astype(np.int32))

    first = (ids.select("doc_id", part_of("doc_id").alias("part")).groupBy("part")
                .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("m"))
                .select("part", "m.doc_id").orderBy("part").collect())       # one row a range
    if not first:
        return spark.createDataFrame([], SCHEMA)
    before = spark.createDataFrame(
        [(first[i].part, first[i - 1].part, first[i].doc_id) for i in range(len(first))],
        "of int, back int, first_id long")
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    row = row.withColumn("part", part_of("doc_id"))
    opens = row.join(F.broadcast(before), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(
        F.col("first_id")), "left")
    places = F.when(F.col("back").isNull(), F.array(F.struct(F.lit(False).alias("ahead"), "part"))).otherwise(
        F.array(F.struct(F.lit(False).alias("ahead"), "part"),
                F.struct(F.lit(True).alias("ahead"), F.col("back").alias("part"))))
    dealt = opens.select("doc_id", "text", F.inline(places))
    dealt = (dealt.repartition(partitions, "part")
                  .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()))
    return dealt.mapInArrow(_stream, SCHEMA)
