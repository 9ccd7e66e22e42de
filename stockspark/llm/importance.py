"""Target-distribution importance resampling (operator 13).

A document's features are all runs of one to three consecutive words, repeats
counted; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. Two
histograms over buckets, of all documents and of all target texts, give each
bucket a gain (the scaled logarithm of the ratio of its smoothed shares); a
document's weight is the sum over its features. Gumbel noise keyed by the id
turns the draw without replacement into the highest scores.

Buckets of a batch: words are numbered exactly by their bytes, runs of two and
three words by the numbers of their parts, so each distinct run is hashed once.
Distinct runs of equal length form a two-dimensional uint8 array; all their
CRCs advance together, one column of bytes at a time, and go back to where the
runs occur. Runs beyond ``LONG`` bytes would be matrices of one row; they go
through the C routine for the same CRC.

A task keeps one histogram and the arrays of at most ``CHUNK`` words, also
inside one very long text. Only the two histograms (``BUCKETS`` rows each) reach the
driver. Ranks come from a range-partitioned sort, so no task holds all rows.

Defined cases: null and wordless texts have no features and weight 0; rows with
a null id have a weight but neither score nor rank and do not count among those
drawn from; a repeated id is scored once a row (equal rows in any order);
without target texts all gains follow from the smoothing alone. Other columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import table
from stockspark.llm.flat import lower_ascii, spans, text_slices
from stockspark.operators.listing import number_rows

BUCKETS = 10_000
RUN = 3                   # words of the longest feature
CHUNK = 400_000           # words worked on at once
SLICE = 2 << 20           # bytes of texts worked on at once
LONG = 512                # bytes of a feature beyond which the C routine takes it
SEED = 42
MIN_WORDS = 20            # of a document that may be drawn
PERCENT = 5               # of these that are drawn

# bytes that are not part of a word once A-Z is lower case: ASCII other than digits and letters
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[:0x30] = NOT_WORD[0x3A:0x61] = NOT_WORD[0x7B:0x80] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc_of_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each byte range of ``data``, ranges of one length at a time."""
    size = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        n = int(size[rows[0]])
        if n > LONG:
            out[rows] = [zlib.crc32(data[starts[i]:ends[i]].tobytes()) for i in rows.tolist()]
            continue
        matrix = data[starts[rows] + np.arange(n)[:, None]]     # a column of bytes of all ranges is one line here
        crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
        for column in matrix:
            crc = _CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def _number(values: pa.Array) -> tuple[np.ndarray, int]:
    """Exact numbers 0, 1, ... of equal values, in order of first occurrence."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def _firsts(number: np.ndarray, distinct: int) -> np.ndarray:
    first = np.empty(distinct, dtype=np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return first


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS
             ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(document, bucket)`` of every feature of one slice, a chunk of words at a time."""
    data = lower_ascii(data)
    starts, ends, doc = spans(data, offsets, NOT_WORD)
    for i in range(0, len(starts), CHUNK):
        own = min(CHUNK, len(starts) - i)                       # runs that start here; they may reach beyond
        some = slice(i, min(i + own + RUN - 1, len(starts)))
        lo, hi, of = starts[some], ends[some], doc[some]
        size = hi - lo
        letters = data[lo[0]:hi[-1]]
        letters = letters[~NOT_WORD[letters]]
        bounds = np.concatenate([[0], np.cumsum(size)])
        word, words = _number(pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]))
        # the words again, one space behind each: a run of words is a range of bytes
        spaced = np.insert(letters, bounds[1:], np.uint8(32))
        at = bounds[:-1] + np.arange(len(size))
        number, distinct, where = word, words, np.arange(len(size))
        for run in range(1, RUN + 1):
            if run > 1:
                ok = (where + run - 1 < len(size))
                ok[ok] = of[where[ok]] == of[where[ok] + run - 1]
                where, number = where[ok], number[ok]
                number, distinct = _number(pa.array(number * words + word[where + run - 1]))
            begun = where < own
            first = where[_firsts(number, distinct)]
            crc = crc_of_ranges(spaced, at[first], at[first + run - 1] + size[first + run - 1])
            yield of[where[begun]], (crc % np.uint32(buckets)).astype(np.int64)[number[begun]]


def _histogram(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("text"), SLICE):
            for _, bucket in features(data, offsets, buckets):
                total += np.bincount(bucket, minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def histogram(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(
        functools.partial(_histogram, buckets=buckets), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():     # at most one row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(smoothed target share / smoothed source share))`` of every bucket."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        n, words, weight = (np.zeros(rows, dtype=np.int64) for _ in range(3))
        for first, end, data, offsets in text_slices(batch.column("text"), SLICE):
            here = slice(first, end)
            for i, (doc, bucket) in enumerate(features(data, offsets, len(gain))):
                here_n = np.bincount(doc, minlength=end - first)
                n[here] += here_n
                if i % RUN == 0:                                 # single words come first in each chunk
                    words[here] += here_n
                weight[here] += np.bincount(doc, weights=gain[bucket], minlength=end - first).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(words), pa.array(weight)],
                                         names=["doc_id", "n_features", "n_words", "weight"])


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
               seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)``.

    ``rank`` is 1, 2, ... for the ``percent`` of the rows with at least
    ``min_words`` words that are drawn towards ``target(text)``, else null.
    """
    gain = gains(histogram(docs, buckets), histogram(target, buckets))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = text.mapInArrow(functools.partial(_weigh, gain=gain),
                              "doc_id long, n_features long, n_words long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = table(weighed.withColumn("score", F.col("weight") + noise), "importance-scored")
    may = scored.where((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull())
    drawn = percent * may.count() // 100
    ranked = number_rows(may.select("doc_id", "n_features", "weight", "score"), [F.desc("score"), "doc_id"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    rest = scored.where((F.col("n_words") < min_words) | F.col("doc_id").isNull())
    return ranked.unionByName(rest.select("doc_id", "n_features", "weight", "score",
                                          F.lit(None).cast("long").alias("rank")))
