"""Toxicity by nearest labelled examples under exact TF-IDF cosine (operator 5).

Terms are lower-cased words and word beginnings. Labelled examples are a
bounded sample (``PER_CLASS`` documents a class, smallest id hash first); on it
the terms that mark toxic documents are those in at least ``MIN_TOXIC`` toxic
examples whose document frequency there exceeds that in all clean labelled
documents by a z-score and a lift. All clean labels count, not the sample, so a
term without clean occurrences needs no more toxic examples where labels are
many. A toxic example that holds none of them brings its own: its heaviest terms, as many as hold
half of the square of its length, so no toxic example is left without terms and a text equal to it
is found at cosine 1. One pass over all texts then counts the selected terms of every document; document frequencies for the idf
come from all documents.

The examples form an inverted index in blocks: for each term its weights and
the largest weight of every block. A query adds up its terms' block maxima,
visits blocks from the highest bound down and stops when no block can hold a
nearer example than the k-th found so far: the k nearest are exact. Examples
with equal vectors share one entry with their class counts, scaled to all labels
of the class. Votes are weighted by count and by exp(-distance / ``SCALE``) and shrunk towards the base rate, so
the score estimates the chance of label 1; the nearest examples are kept as
evidence. A document without any selected term is scored by the rate of toxic
labels among examples without one.

Defined cases: null and empty texts are scored like any text without selected
terms. Without labelled examples every score is 0. Null labels and labels of
absent documents are ignored; a document labelled twice is toxic if one label
says so. Rows that repeat a doc_id are scored one by one by their own text.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.common import held_out, id_side, learned, small_batches, table
from stockspark.llm.flat import U64, RangeHash, lower_ascii, mix64, spans, text_slices

PER_CLASS = 10_000         # labelled examples of each class that are learned from
MIN_Z = 4.0                # of a selected term
MIN_LIFT = 4.0             # times as frequent in toxic examples as in others
MIN_TOXIC = 2              # toxic examples that a selected term is in
HEAVY = 0.5                # of the square of a vector's length: terms taken of a toxic example without marking ones
BEGINNINGS = (4, 5, 6, 7)  # bytes
BLOCK = 64                 # examples
BLOCKS_AT_ONCE = 8         # that are scored before the bound is looked at again
NEAREST = 24               # example entries
SCALE = 0.15               # of the cosine distance
SHRINK = 1.0               # votes at the base rate
ROWS_A_TASK = 8_000        # that are scored
KEPT_SCORES = 20_000       # remembered scores of a task, some 10 MB
THRESHOLD = 0.3            # fixed by the contract

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[97:123] = False
_SEPARATOR[128:] = False


# two-byte letters: lead byte, first and last second byte of capitals, what to add to lead and second byte
_CAPITALS = [(0xC3, 0x80, 0x9E, 0, 0x20),                                     # Latin-1
             (0xCE, 0x91, 0x9F, 0, 0x20), (0xCE, 0xA0, 0xA9, 1, -0x20),       # Greek
             (0xD0, 0x90, 0x9F, 0, 0x20), (0xD0, 0xA0, 0xAF, 1, -0x20)]       # Cyrillic


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters and two-byte Latin-1, Greek and Cyrillic letters in lower case."""
    out = lower_ascii(data)
    if len(data) > 1:
        for lead, lo, hi, add_lead, add in _CAPITALS:
            at = np.flatnonzero(data[:-1] == lead)
            second = data[at + 1]
            at = at[(second >= lo) & (second <= hi) & ((lead != 0xC3) | (second != 0x97))]
            out[at] += np.uint8(add_lead)
            out[at + 1] = (data[at + 1].astype(np.int16) + add).astype(np.uint8)
    return out


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, term hash)`` of all words and word beginnings of one slice."""
    data = lowered(data)
    starts, ends, doc = spans(data, offsets, _SEPARATOR)
    h = RangeHash(data)
    docs, hashes = [doc], [h(starts, ends)]
    for n in BEGINNINGS:
        longer = ends - starts > n
        docs.append(doc[longer])
        hashes.append(mix64(h(starts[longer], starts[longer] + n) ^ U64(n)))
    return np.concatenate(docs), np.concatenate(hashes)


def _term_counts(batches: Iterator[pa.RecordBatch], among: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Document frequencies of terms (of sorted ones, if given), summed over each batch."""
    for batch in batches:
        found: list[np.ndarray] = []
        for _, _, data, offsets in text_slices(batch.column("text")):
            doc, term = terms(data, offsets)
            if among is not None:
                at = np.minimum(np.searchsorted(among, term), len(among) - 1)
                hit = among[at] == term
                doc, term = doc[hit], term[hit]
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
            found.append(term[new])
        term, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count)], names=["term", "n"])


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Selected terms of each document and how often they occur."""
    mask = U64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, dtype=bool)
    maybe[(vocabulary & mask).astype(np.int64)] = True
    size = max(1, len(vocabulary))
    for batch in batches:
        lists: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        lengths = []
        for first, end, data, offsets in text_slices(batch.column("text")):
            doc, term = terms(data, offsets)
            hit = maybe[(term & mask).astype(np.int64)]
            doc, term = doc[hit], term[hit]
            at = np.minimum(np.searchsorted(vocabulary, term), size - 1)
            real = vocabulary[at] == term if len(vocabulary) else np.zeros(0, bool)
            key, n = np.unique(doc[real] * size + at[real], return_counts=True)
            lengths.append(np.bincount(key // size, minlength=end - first))
            lists.append(key % size)
            counts.append(n)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        off = pa.array(np.concatenate([[0], np.cumsum(cat(lengths))]).astype(np.int32))
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept],
             pa.ListArray.from_arrays(off, pa.array(cat(lists).astype(np.int32))),
             pa.ListArray.from_arrays(off, pa.array(cat(counts).astype(np.int32)))],
            names=[*kept, "term", "tf"])


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, one range after the other, and the range of each."""
    size = end - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (first - np.cumsum(size) + size)[of], of


def _unmarked(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All terms of the documents that hold none of the vocabulary's, and how often they occur."""
    size = max(1, len(vocabulary))
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        docs, found, counts = [], [], []
        for first, end, data, offsets in text_slices(batch.column("text")):
            doc, term = terms(data, offsets)
            at = np.minimum(np.searchsorted(vocabulary, term), size - 1)
            known = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
            open_ = np.bincount(doc[known], minlength=end - first) == 0
            for i in np.flatnonzero(open_):
                t, n = np.unique(term[doc == i], return_counts=True)
                docs.append(np.full(len(t), ids[first + i], dtype=np.int64))
                found.append(t.view(np.int64))
                counts.append(n)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cat(docs)), pa.array(cat(found)), pa.array(cat(counts))],
                                         names=["doc_id", "term", "tf"])


def heavy_terms(toxic: DataFrame, clean: DataFrame, vocabulary: np.ndarray, n_clean: int) -> np.ndarray:
    """Of each of the ``toxic`` examples without a term of ``vocabulary`` its heaviest terms (idf by all ``clean`` ones)."""
    own = table(toxic.select("doc_id", "text").mapInArrow(functools.partial(_unmarked, vocabulary=vocabulary),
                                                          "doc_id long, term long, tf long"), "toxic-unmarked")
    if not own.limit(1).count():
        return vocabulary
    counted = clean.select("text").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).join(own.select("term").distinct(), "term", "left_semi")
    idf = F.log((1.0 + n_clean) / (1.0 + F.coalesce("n", F.lit(0)))) + 1.0
    square = own.join(counted, "term", "left").withColumn("w", F.round(F.pow((1.0 + F.log("tf")) * idf, F.lit(2.0)), 9))
    # equally heavy terms go together
    levels = square.groupBy("doc_id", "w").agg(F.sum(F.lit(1.0) * F.col("w")).alias("level"))
    upto = Window.partitionBy("doc_id").orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("before", F.coalesce(F.sum("level").over(upto), F.lit(0.0))).withColumn(
        "all", F.sum("level").over(Window.partitionBy("doc_id"))).where(F.col("before") < HEAVY * F.col("all"))
    least = levels.groupBy("doc_id").agg(F.min("w").alias("least"))
    taken = square.join(least, "doc_id").where(F.col("w") >= F.col("least"))
    new = np.array([r.term for r in taken.select("term").distinct().collect()], dtype=np.int64).view(np.uint64)
    return np.union1d(vocabulary, new)


@dataclass
class Index:
    """Block-max inverted index of example vectors with class counts."""

    idf: np.ndarray
    example: np.ndarray        # postings: example number, ascending within a term
    weight: np.ndarray
    cells: np.ndarray          # where the cells of each term start, a cell being a block that has the term
    block: np.ndarray          # of each cell
    block_max: np.ndarray      # of each cell
    start: np.ndarray          # where the postings of each cell start; one entry more
    toxic: np.ndarray          # votes of each example entry
    clean: np.ndarray
    doc_id: np.ndarray         # one document of each entry
    base: float                # rate of toxic labels
    empty: float               # among examples without selected terms

    def unit(self, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1.0 + np.log(tf)) * self.idf[term]
        return w / np.sqrt((w * w).sum())

    def nearest(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact: the NEAREST entries by cosine above 0, ties to the smaller entry."""
        cell, of = ranges(self.cells[term], self.cells[term + 1])
        block, share = self.block[cell], weight[of]
        blocks = int(block.max()) + 1 if len(block) else 0
        bound = np.bincount(block, weights=share * self.block_max[cell], minlength=blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rank = np.empty(blocks, dtype=np.int64)
        rank[order] = np.arange(len(order))
        turn = rank[block]
        by_turn = np.argsort(turn, kind="stable")
        cell, share, turn = cell[by_turn], share[by_turn], turn[by_turn]
        best_s, best_e = np.zeros(0), np.zeros(0, dtype=np.int64)
        for n in range(0, len(order), BLOCKS_AT_ONCE):
            if len(best_s) == NEAREST and bound[order[n]] * (1 + 1e-9) < best_s[-1]:
                break
            lo, hi = np.searchsorted(turn, [n, n + BLOCKS_AT_ONCE])
            at, of = ranges(self.start[cell[lo:hi]], self.start[cell[lo:hi] + 1])
            part = share[lo:hi][of]
            example, number = np.unique(self.example[at], return_inverse=True)
            score = np.bincount(number, weights=part * self.weight[at])
            best_s, best_e = np.concatenate([best_s, score]), np.concatenate([best_e, example])
            best = np.lexsort((best_e, -best_s))[:NEAREST]
            best_s, best_e = best_s[best], best_e[best]
        return best_e, np.minimum(best_s, 1.0)

    def score(self, term: np.ndarray, tf: np.ndarray) -> tuple[float, list[int]]:
        """Calibrated score and the nearest examples' documents."""
        if not len(term):
            return self.empty, []
        entry, cosine = self.nearest(term, self.unit(term, tf))
        vote = np.exp((cosine - 1.0) / SCALE)
        toxic, clean = (vote * self.toxic[entry]).sum(), (vote * self.clean[entry]).sum()
        return (float((toxic + SHRINK * self.base) / (toxic + clean + SHRINK)),
                self.doc_id[entry[:3]].tolist())


def build_index(examples: list[tuple], idf: np.ndarray, clean_weight: float, toxic_weight: float = 1.0) -> Index:
    """``examples``: (terms, counts, toxic votes, clean votes, doc_id) of distinct vectors; weights: labels a vote."""
    filled = sorted((e for e in examples if len(e[0])), key=lambda e: (list(e[0]), list(e[1])))
    toxic = np.array([e[2] for e in filled], dtype=float) * toxic_weight
    clean = np.array([e[3] for e in filled], dtype=float) * clean_weight
    index = Index(idf, None, None, None, None, None, None, toxic, clean,
                  np.array([e[4] for e in filled], dtype=np.int64), 0., 0.)
    rows, cols, weights = [], [], []
    for n, e in enumerate(filled):
        t = np.asarray(e[0], dtype=np.int64)
        rows.append(t)
        cols.append(np.full(len(t), n))
        weights.append(index.unit(t, np.asarray(e[1], dtype=float)))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    row, col, weight = cat(rows), cat(cols), cat(weights)
    order = np.lexsort((col, row))
    row, index.example, index.weight = row[order], col[order], weight[order]
    blocks = len(filled) // BLOCK + 1
    cell = row * blocks + index.example // BLOCK
    cell, first = np.unique(cell, return_index=True)
    index.start = np.append(first, len(row))
    index.block = cell % blocks
    index.block_max = np.maximum.reduceat(index.weight, first) if len(first) else np.zeros(0)
    index.cells = np.searchsorted(cell // blocks, np.arange(len(idf) + 1))
    t0 = sum(e[2] for e in examples if not len(e[0])) * toxic_weight
    c0 = sum(e[3] for e in examples if not len(e[0])) * clean_weight
    total = toxic.sum() + clean.sum() + t0 + c0
    index.base = float((toxic.sum() + t0) / total) if total else 0.0
    index.empty = float((t0 + SHRINK * index.base) / (t0 + c0 + SHRINK))
    return index


def _scores(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index, known = shared.value, {}
    for batch in batches:
        scores, nearest = [], []
        terms_, counts = batch.column("term"), batch.column("tf")
        off = terms_.offsets.to_numpy() - terms_.offsets[0].as_py()
        term, tf = terms_.flatten().to_numpy(), counts.flatten().to_numpy()
        for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
            t, n = term[lo:hi], tf[lo:hi]
            key = t.tobytes() + n.tobytes()                 # equal vectors are scored once
            got = known.get(key)
            if got is None:
                if len(known) >= KEPT_SCORES:
                    known.clear()
                got = known[key] = index.score(t.astype(np.int64), n.astype(float))
            scores.append(got[0])
            nearest.append(got[1])
        kept = [c for c in batch.schema.names if c not in ("term", "tf")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], pa.array(scores, pa.float64()), pa.array(nearest, pa.list_(pa.int64()))],
            names=[*kept, "score", "nearest"])


def text_key() -> list[Column]:
    """``text_a, text_b``: 128 bits that stand for a text (null: the empty one)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("b"), F.reverse(text)).alias("text_b")]


def toxicity(docs: DataFrame, labels: DataFrame, with_key: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted, nearest`` of every row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)``; only rows outside the held-out quarter are learned from. ``with_key`` adds
    ``text_key()``: a score depends on the text alone, so it names rows where ids are null or repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = text_key() if with_key else []
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *key)
    known = (labels.where(learned(F.col("doc_id")) & F.col("toxic").isNotNull())
                   .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    known = known.select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    sample = table(known.where("toxic").orderBy(order, "doc_id").limit(PER_CLASS).unionByName(
        known.where("not toxic").orderBy(order, "doc_id").limit(PER_CLASS)), "toxic-sample")
    sampled = {c: min(totals.get(c, 0), PER_CLASS) for c in (True, False)}
    toxic_weight, clean_weight = (totals.get(c, 0) / max(1, sampled[c]) for c in (True, False))

    # at most 2 * PER_CLASS ids: a broadcast of proven size
    examples = text.join(F.broadcast(sample), "doc_id")
    marked = (examples.where("toxic").select("text").mapInArrow(_term_counts, "term long, n long")
                      .groupBy("term").agg(F.sum("n").alias("toxic")).where(F.col("toxic") >= MIN_TOXIC))
    marked = table(marked, "toxic-terms")
    among = np.sort(np.array([r.term for r in marked.select("term").collect()], dtype=np.int64).view(np.uint64))
    vocabulary = among
    clean_texts = text.join(id_side(table(known.where("not toxic").select("doc_id"), "clean-labels")), "doc_id")
    if len(among):
        clean = (clean_texts.select("text").mapInArrow(functools.partial(_term_counts, among=among), "term long, n long")
                      .groupBy("term").agg(F.sum("n").alias("clean")))
        counted = marked.join(clean, "term", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
        n1, n0 = float(max(1, sampled[True])), float(max(1, totals.get(False, 0)))
        p1, p0 = (F.col("toxic") + 0.5) / (n1 + 1), (F.col("clean") + 0.5) / (n0 + 1)
        rate = (F.col("toxic") + F.col("clean") + 1) / (n1 + n0 + 2)
        z = (p1 - p0) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
        chosen = counted.where((z >= MIN_Z) & (p1 >= MIN_LIFT * p0)).select("term").collect()
        vocabulary = np.sort(np.array([r.term for r in chosen], dtype=np.int64).view(np.uint64))
    vocabulary = heavy_terms(examples.where("toxic"), clean_texts, vocabulary, totals.get(False, 0))

    kept = "doc_id long" + (", text_a long, text_b long" if with_key else "")
    vectors = table(text.mapInArrow(functools.partial(_vectors, vocabulary=vocabulary),
                                    f"{kept}, term array<int>, tf array<int>"), "toxic-vectors")
    df = np.zeros(len(vocabulary))
    for r in vectors.select(F.explode("term").alias("t")).groupBy("t").count().collect():
        df[r.t] = r["count"]
    rows = vectors.count()
    idf = np.log((1 + rows) / (1 + df)) + 1
    entries = (vectors.join(F.broadcast(sample), "doc_id").groupBy("term", "tf")
                      .agg(F.sum(F.col("toxic").cast("long")).alias("y"), F.count("*").alias("n"),
                           F.min("doc_id").alias("doc_id")).collect())
    index = build_index([(e.term, e.tf, e.y, e.n - e.y, e.doc_id) for e in entries], idf, clean_weight,
                        toxic_weight)
    # the vectors are few bytes of much work: spread them over the cores by rows, not by file size
    spread = vectors.repartition(max(spark.sparkContext.defaultParallelism, rows // ROWS_A_TASK + 1))
    scored = spread.mapInArrow(functools.partial(_scores, shared=spark.sparkContext.broadcast(index)),
                               f"{kept}, score double, nearest array<long>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "nearest",
                         *[c.split()[0] for c in kept.split(", ")[1:]])
