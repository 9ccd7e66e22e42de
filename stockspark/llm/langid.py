"""Language identification as a mixture of languages (operator 3).

Model: for every language the frequencies of letter n-grams inside words (with
word ends), counted over all learned documents. A word's likelihood under a
language is the product of its n-gram probabilities.

Inference per document: expectation-maximisation over its words estimates the
proportion of each language. The set of languages is chosen by penalised
likelihood: starting from all languages, the smallest proportion is dropped
and the mixture fitted again as long as the likelihood lost is smaller than
the penalty saved, ``log(words) / 2`` a language. The prediction is the language
with the largest proportion (ties: first by name), the score its proportion.

N-grams are hashed into ``SLOTS`` slots, so a language's model has a fixed size
whatever the corpus, and counts are summed per batch before they are shuffled. With more than
``CELLS / SLOTS`` languages the slots are folded, so that the model stays within ``CELLS``
numbers; any number of languages is learned. A text longer than a slice is worked off in pieces: its
distinct words with their counts give the same mixture as its words one by one.

Defined cases: null text and texts without a letter give ``und`` with score 0;
without learned documents every text is ``und``. Null lang and null doc_id rows
are not learned from. Repeated rows get equal results, other columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import held_out, learned, table
from stockspark.llm.flat import SLICE_BYTES, U64, RangeHash, spans, text_slices
from stockspark.llm.toxicity import _SEPARATOR as NOT_LETTER
from stockspark.llm.toxicity import lowered

GRAM = 3                  # bytes of an n-gram; shorter words count as one n-gram
SLOTS = 1 << 16           # of hashed n-grams
SMOOTH = 0.5              # added to every slot's count
CELLS = 1 << 24           # slots x languages of a model: bounds the broadcast at 64 MB
LEAST_SLOTS = 1 << 8      # with more languages than CELLS / LEAST_SLOTS the model grows with them
LIKELIHOODS = 1 << 26     # words x languages of the texts that are worked on at once
STEPS = 12                # of expectation-maximisation over all languages
MORE_STEPS = 5            # after a language is dropped, from the proportions before
SETTLED = 1e-3            # largest change of a proportion at which it stops
FLOOR = -60.0             # log-likelihoods are taken relative to the best language, down to here


def slots_of(languages: int) -> int:
    """Slots of a language's model: a power of two, fewer where there are many languages."""
    few = max(LEAST_SLOTS, CELLS // max(1, languages))
    return min(SLOTS, 1 << (few.bit_length() - 1))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(slots, word of each n-gram, document and hash of each word)`` of one slice.

    A word is taken with one byte around it as its end marks.
    """
    # a separator in front of every text and at the end: no n-gram depends on a neighbouring row
    data = np.insert(lowered(data), offsets, np.uint8(32))
    marked = np.where(NOT_LETTER[data], np.uint8(32), data)
    starts, ends, doc = spans(marked, offsets + np.arange(len(offsets)), NOT_LETTER)
    starts, ends = starts - 1, ends + 1                 # with both end marks
    n = np.maximum(ends - starts - GRAM + 1, 1)
    word = np.repeat(np.arange(len(starts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    stop = np.minimum(at + GRAM, ends[word]) if len(word) else at
    hashed = RangeHash(marked)
    return (hashed(at, stop) >> U64(48)).astype(np.int64) % SLOTS, word, doc, lambda: hashed(starts, ends)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        of_row = np.array([number[x] for x in langs], dtype=np.int64)
        total = np.zeros(len(names) * SLOTS, dtype=np.int64)
        for first, _, data, offsets in text_slices(batch.column("text")):
            slot, word, doc, _ = grams(data, offsets)
            total += np.bincount(of_row[first + doc[word]] * SLOTS + slot, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in at // SLOTS], pa.string()), pa.array(at % SLOTS), pa.array(total[at])],
            names=["lang", "slot", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names and log-probabilities (slots x languages) of ``docs(text, lang)``."""
    counted = (docs.select("text", "lang").mapInArrow(_counts, "lang string, slot long, n long")
                   .groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    counted = table(counted, "language-counts")
    names = sorted(r.lang for r in counted.select("lang").distinct().collect())       # one row a language
    slots = slots_of(len(names))
    number = {x: i for i, x in enumerate(names)}
    count = np.full((slots, len(names)), SMOOTH, dtype=np.float32 if len(names) > 256 else np.float64)
    # one row a language: its filled slots, at most ``slots`` of them
    folded = counted.groupBy("lang", (F.col("slot") % slots).alias("slot")).agg(F.sum("n").alias("n"))
    for r in folded.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("c")).toLocalIterator():
        at = np.array([(x.slot, x.n) for x in r.c], dtype=np.int64)
        count[at[:, 0], number[r.lang]] += at[:, 1]
    total = count.sum(axis=0, dtype=np.float64)
    return names, np.log(count / total).astype(np.float32)


def mixture(like: np.ndarray, words: np.ndarray, share: np.ndarray, steps: int, times: np.ndarray | None = None
            ) -> tuple[np.ndarray, np.ndarray]:
    """EM proportions (documents x languages) and log-likelihoods, all documents at once.

    ``like``: likelihoods of each word, document by document, scaled so the best
    language has 1. ``words``: words of each document, none empty. ``share``:
    proportions to start from; a language at 0 stays out. ``times``: how often each word occurs (once, if not given).
    """
    first = np.cumsum(words) - words
    size = words if times is None else np.add.reduceat(times, first)
    for _ in range(steps):
        joint = like * np.repeat(share, words, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        if times is not None:
            joint *= times[:, None]
        new = np.add.reduceat(joint, first, axis=0) / size[:, None]
        moved = np.abs(new - share).max()
        share = new.astype(np.float32)
        if moved < SETTLED:
            break
    total = np.log(np.maximum((like * np.repeat(share, words, axis=0)).sum(axis=1, dtype=np.float64), 1e-300))
    return share, np.add.reduceat(total if times is None else total * times, first)


def select(like: np.ndarray, words: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Proportions of each document over its selected languages."""
    docs, languages = len(words), like.shape[1]
    size = words if times is None else np.add.reduceat(times, np.cumsum(words) - words)
    penalty = np.log(np.maximum(size, 2)) / 2
    start = np.full((docs, languages), 1 / languages, dtype=np.float32)
    best, best_like = mixture(like, words, start, STEPS, times)
    active = np.arange(docs)
    while True:
        active = active[(best[active] > 0).sum(axis=1) > 1]
        if not len(active):
            return best
        trial = best[active].copy()
        drop = np.where(trial > 0, trial, np.inf).argmin(axis=1)
        trial[np.arange(len(active)), drop] = 0
        trial /= trial.sum(axis=1, keepdims=True)
        chosen = np.zeros(docs, dtype=bool)
        chosen[active] = True
        here = np.repeat(chosen, words)
        got, got_like = mixture(like[here], words[active], trial, MORE_STEPS, None if times is None else times[here])
        better = best_like[active] - got_like < penalty[active]
        active = active[better]
        best[active], best_like[active] = got[better], got_like[better]


def word_likelihoods(slot: np.ndarray, word: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Likelihoods (words x languages) relative to each word's best language; n-grams come word by word."""
    begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    like = np.add.reduceat(logs[slot], begin, axis=0)
    return np.exp(np.maximum(like - like.max(axis=1, keepdims=True), FLOOR))


def long_text(data: np.ndarray, logs: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods and counts of the distinct words of one text, worked out in pieces of about ``piece`` bytes.

    Memory is one piece and the distinct words, however long the text.
    """
    seen, like, times = np.zeros(0, np.uint64), np.zeros((0, logs.shape[1]), logs.dtype), np.zeros(0, np.int64)
    at = 0
    while at < len(data):
        end = min(at + piece, len(data))
        if end < len(data):                      # cut behind a separator: an ASCII byte that is in no word
            gap = np.flatnonzero(NOT_LETTER[lowered(data[at:end])])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                while end < len(data) and not NOT_LETTER[lowered(data[end:end + 1])][0]:
                    end += 1
        slot, word, doc, hashes = grams(data[at:end], np.array([0, end - at]))
        at = end
        if not len(word):
            continue
        slot %= len(logs)
        new, first, n = np.unique(hashes(), return_index=True, return_counts=True)
        both, index = np.unique(np.concatenate([seen, new]), return_index=True)
        like = np.concatenate([like, word_likelihoods(slot, word, logs)[first]])[index]
        count = np.zeros(len(both), np.int64)
        count[np.searchsorted(both, seen)] += times
        count[np.searchsorted(both, new)] += n
        seen, times = both, count
    return like, times


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    names, logs = shared.value
    # a word is two bytes at least; many languages mean smaller slices
    bytes_at_once = min(SLICE_BYTES, max(4096, LIKELIHOODS // max(1, len(names)) * 2))
    for batch in batches:
        pred, score, mix = [], [], []
        for first, end, data, offsets in text_slices(batch.column("text"), bytes_at_once):
            rows = end - first
            if len(names) and rows == 1 and len(data) > 2 * bytes_at_once:
                like, times = long_text(data, logs, bytes_at_once)
                doc, word = np.zeros(len(times), np.int64), times
            else:
                like, times = None, None
                slot, word, doc, _ = grams(data, offsets)
                slot %= len(logs) if len(names) else SLOTS
            lettered = np.bincount(doc, minlength=rows) > 0
            for i in np.flatnonzero(lettered):
                raw = data[offsets[i]:offsets[i + 1]]
                if not (((raw | 32) >= 97) & ((raw | 32) <= 122)).any():     # only bytes beyond ASCII
                    lettered[i] = any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))
            if len(names) and len(word):
                if like is None:
                    like = word_likelihoods(slot, word, logs)
                words = np.bincount(doc, minlength=rows)
                share = np.zeros((rows, len(names)))
                share[words > 0] = select(like, words[words > 0], times)
            else:
                share = np.zeros((rows, max(1, len(names))))
                lettered[:] = False
            top = share.argmax(axis=1)
            for i in range(rows):
                pred.append(names[top[i]] if lettered[i] else "und")
                score.append(min(1.0, float(share[i, top[i]])) if lettered[i] else 0.0)
                mix.append([(names[k], float(share[i, k])) for k in np.flatnonzero(share[i] > 0)]
                           if lettered[i] else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
             pa.array(mix, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "mixture"])


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, mixture`` of every row of ``docs(doc_id, text, lang)``."""
    known = docs.where(learned(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(
        fit(known.select(F.col("text").cast("string"), F.col("lang").cast("string"))))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = text.mapInArrow(functools.partial(_predict, shared=model),
                            "doc_id long, lang_pred string, score double, mixture map<string,double>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
