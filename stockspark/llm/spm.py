"""SentencePiece merge-type (BPE) encoding and decoding (operator 8).

Encoding is exact and runs by backtracking, not by a merge queue. An
Aho-Corasick pass over a segment finds every vocabulary piece at every
position. From the left the longest piece is tried; it is accepted if it is
compatible with the piece before it, that is, if merging the two pieces' own
text again from single characters gives back exactly these two pieces.
Otherwise the next shorter piece is tried; when none is left, the position is
marked as failed in a bitfield and the step before is taken back. Each
position fails at most once, so a text costs time linear in its length.

No piece of the vocabulary crosses the start of a space run, a character
outside the vocabulary, or two characters that are neighbours inside no piece,
so a text is cut there and the encodings of recent segments are remembered (a
bounded number of them).

Decoding joins pieces, turns runs of byte pieces into UTF-8 (each invalid byte
becomes U+FFFD) and takes back the dummy prefix.

Defined cases: null text is encoded as empty text; empty text has no ids.
Rows are independent: repeated rows give repeated results, other columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import small_batches

SPACE = "▁"
KEPT_SEGMENTS = 1 << 18      # remembered segments a worker, some 60 MB
KEPT_PAIRS = 1 << 18         # remembered compatibility checks a worker
KEPT_LENGTH = 48             # longer segments are encoded each time

_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, scores and kinds of a model file, by id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool
    unknown_surface: str


def load(model_file: str) -> Vocabulary:
    """Read a model file; raise for settings that this encoder does not implement."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    spec, norm = model.trainer_spec, model.normalizer_spec
    pieces = tuple(p.piece for p in model.pieces)
    kinds = tuple(int(p.type) for p in model.pieces)
    if spec.model_type != spec.BPE or not spec.byte_fallback or spec.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback and space prefixes are supported")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    if set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    if any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds) if k == _NORMAL):
        raise ValueError("pieces with inner spaces are not supported")
    return Vocabulary(pieces, tuple(p.score for p in model.pieces), kinds, norm.add_dummy_prefix,
                      spec.unk_surface)


class Codec:
    """Encoder and decoder of one vocabulary; holds the bounded memories."""

    def __init__(self, vocab: Vocabulary):
        import ahocorasick
        self._vocab = vocab
        self._id = {p: i for i, (p, k) in enumerate(zip(vocab.pieces, vocab.kinds)) if k == _NORMAL}
        self._byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(vocab.pieces, vocab.kinds)) if k == _BYTE}
        self._byte = {i: b for b, i in self._byte_id.items()}
        self._length = [len(p) for p in vocab.pieces]
        # what an id decodes to by itself; None for byte pieces, which need their neighbours
        self._surface = [p.replace(SPACE, " ") if k == _NORMAL else vocab.unknown_surface if k == _UNKNOWN
                         else "" if k == _CONTROL else None for p, k in zip(vocab.pieces, vocab.kinds)]
        self._characters = frozenset(p for p in self._id if len(p) == 1)
        self._inside = frozenset(p[k:k + 2] for p in self._id for k in range(len(p) - 1))
        self._matcher = ahocorasick.Automaton()
        for p, i in self._id.items():
            if self.merge(p) == [p]:              # a piece that merging never gives cannot be in an encoding
                self._matcher.add_word(p, i)
        self._matcher.make_automaton()
        self._pair: dict[int, bool] = {}
        self._segment: dict[str, tuple[str, int, str]] = {}
        self._arrays: dict[str, bytes] = {}

    # ------------------------------------------------------------ encoding
    def merge(self, text: str) -> list[str]:
        """Plain merging: join the best-scored adjacent pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self._id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self._vocab.scores[i] > best):
                    best, at = self._vocab.scores[i], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Merging the two pieces' text again gives exactly the two pieces."""
        a, b = self._vocab.pieces[left], self._vocab.pieces[right]
        if len(self._pair) >= KEPT_PAIRS:
            self._pair.clear()
        ok = self._pair[left << 32 | right] = self.merge(a + b) == [a, b]
        return ok

    def _known(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        length, pair = self._length, self._pair
        found: list[list[int]] = [[] for _ in text]      # by start, shortest first
        for end, i in self._matcher.iter(text):
            found[end - length[i] + 1].append(i)
        failed = bytearray(len(text) + 1)
        out: list[int] = []
        taken: list[int] = []                            # index in found of each accepted piece
        pos, size, last, at = 0, len(text), -1, len(found[0]) - 1
        while pos < size:
            here = found[pos]
            while at >= 0:
                i = here[at]
                if not failed[pos + length[i]]:
                    if last < 0:
                        break
                    fits = pair.get(last << 32 | i)
                    if fits or fits is None and self._fits(last, i):
                        break
                at -= 1
            if at >= 0:
                last = i
                out.append(i)
                taken.append(at)
                pos += length[i]
                if pos < size:
                    at = len(found[pos]) - 1
            else:
                if last < 0:
                    raise ValueError("no encoding of a text of known characters")
                failed[pos] = 1
                pos -= length[out.pop()]
                last = out[-1] if out else -1
                at = taken.pop() - 1
        return out

    def _ids(self, segment: str) -> list[int]:
        """Ids of any segment: byte pieces for characters outside the vocabulary."""
        if self._characters.issuperset(segment):
            return self._known(segment)
        out: list[int] = []
        start = 0
        for k, c in enumerate(segment):
            if c not in self._characters:
                if k > start:
                    out += self._known(segment[start:k])
                out += [self._byte_id[b] for b in c.encode("utf-8")]
                start = k + 1
        if start < len(segment):
            out += self._known(segment[start:])
        return out

    def _parts(self, segment: str) -> list[str]:
        """Cut between characters that are neighbours inside no piece: no merge crosses there."""
        inside, out, start = self._inside, [], 0
        for k in range(1, len(segment)):
            if segment[k - 1:k + 1] not in inside:
                out.append(segment[start:k])
                start = k
        out.append(segment[start:])
        return out

    def _entry(self, segment: str) -> tuple[str, int, str]:
        """Ids of a segment as text, their number, and the text they decode to."""
        got = self._segment.get(segment)
        if got is None:
            parts = self._parts(segment)
            if len(parts) > 1 and len(segment) <= KEPT_LENGTH:
                each = [self._entry(p) for p in parts]
                got = ",".join([e[0] for e in each]), sum([e[1] for e in each]), "".join([e[2] for e in each])
            else:
                ids = [i for p in parts for i in self._ids(p)]
                got = ",".join(map(str, ids)), len(ids), self.surface(ids)
            if len(segment) <= KEPT_LENGTH:
                if len(self._segment) >= KEPT_SEGMENTS:
                    self._segment.clear()
                self._segment[segment] = got
        return got

    def _array(self, segment: str) -> bytes:
        """Ids of a segment as the bytes of 32-bit numbers."""
        got = self._arrays.get(segment)
        if got is None:
            got = np.array([i for p in self._parts(segment) for i in self._ids(p)], dtype=np.int32).tobytes()
            if len(segment) <= KEPT_LENGTH:
                if len(self._arrays) >= KEPT_SEGMENTS:
                    self._arrays.clear()
                self._arrays[segment] = got
        return got

    def _segments(self, text: str) -> Iterator[str]:
        """Cut at the start of every space run and around line ends (no piece holds one)."""
        if self._vocab.dummy_prefix:
            text = " " + text
        text = text.replace(SPACE, " ")
        lines = "\n" not in self._id
        for n, line in enumerate(text.split("\n") if lines else [text]):
            if n:
                yield "\n"
            words = line.split(" ")
            if words[0]:
                yield words[0]
            run = 0
            for w in words[1:]:
                run += 1
                if w:
                    yield SPACE * run + w
                    run = 0
            if run:
                yield SPACE * run

    def encode_array(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        return np.frombuffer(b"".join([self._array(s) for s in self._segments(text)]), dtype=np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(text).tolist()

    # ------------------------------------------------------------ decoding
    def surface(self, ids: list[int]) -> str:
        """Text of consecutive ids, before the dummy prefix is taken back."""
        try:
            return "".join([self._surface[i] for i in ids])
        except TypeError:                         # byte pieces
            pass
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self._byte:
                run.append(self._byte[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i is None:
                break
            out.append(self._surface[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if self._vocab.kinds[i] != _CONTROL), None)
        text = self.surface(ids)
        if first is not None and self._vocab.dummy_prefix and self._vocab.pieces[first].startswith(SPACE):
            return text[1:]
        return text

    # ------------------------------------------------------------- digests
    def digest(self, text: str | None) -> tuple[int, str, str]:
        """``(n_tokens, sha256 of the ids, sha256 of the decoded text)``."""
        if not text:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        parts = [self._entry(s) for s in self._segments(text)]
        surface = "".join([p[2] for p in parts])
        if self._vocab.dummy_prefix and surface.startswith(" "):
            surface = surface[1:]
        return (sum([p[1] for p in parts]),
                hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest(),
                hashlib.sha256(surface.encode("utf-8")).hexdigest())


def _one_byte(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("stockspark-one-byte", _one_byte)


def _utf8(raw: bytes) -> str:
    """Text of bytes; every byte that starts no valid character is one replacement character."""
    return raw.decode("utf-8", "stockspark-one-byte")


@functools.lru_cache(maxsize=2)
def _codec(vocab: Vocabulary) -> Codec:
    return Codec(vocab)


def _digests(batches: Iterator[pa.RecordBatch], vocab) -> Iterator[pa.RecordBatch]:
    codec = _codec(vocab.value)
    for batch in batches:
        rows = [codec.digest(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
             pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(batches: Iterator[pa.RecordBatch], vocab) -> Iterator[pa.RecordBatch]:
    codec = _codec(vocab.value)
    for batch in batches:
        ids = [codec.encode_array(t) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "ids"])


def _texts(batches: Iterator[pa.RecordBatch], vocab) -> Iterator[pa.RecordBatch]:
    codec = _codec(vocab.value)
    for batch in batches:
        text = [codec.decode(x or []) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())],
                                         names=["doc_id", "text"])


def _inputs(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs(doc_id, text)``."""
    vocab = docs.sparkSession.sparkContext.broadcast(load(model_file))
    return _inputs(docs).mapInArrow(functools.partial(_ids, vocab=vocab), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` of every row of ``encoded(doc_id, ids)``; null ids decode to empty text."""
    vocab = encoded.sparkSession.sparkContext.broadcast(load(model_file))
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")
                          ).mapInArrow(functools.partial(_texts, vocab=vocab), "doc_id long, text string")


def encode_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``."""
    vocab = docs.sparkSession.sparkContext.broadcast(load(model_file))
    return _inputs(docs).mapInArrow(
        functools.partial(_digests, vocab=vocab),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
