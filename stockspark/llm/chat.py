"""Chat formatting by incremental black-box rendering (operator 7).

A template is any function from a list of ``(role, text)`` turns to a string;
nothing is assumed about its marks. The turns of a conversation are rendered
prefix by prefix: what a longer prefix adds is the span of its last turn. If an
output does not start with the output before it, the template rewrites
history: the turn is flagged and its span starts where the outputs part. The
place of a turn's text inside its span is found by rendering the same prefix
with two different one-character texts. The loss mask is the text of assistant
turns.

Rows are sorted by conversation and turn and streamed. Prefixes are rendered
whole, so rewriting is seen at any length. Of a template that the caller
declares local (a turn's addition depends on a few turns before it at most, as
in the built-in one) only the first ``WHOLE`` turns are; later turns are rendered
behind the ``CONTEXT`` turns before them, after checking on each such turn that
one turn less of context gives the same addition, and an error is raised if it
does not. So such a conversation of any length needs the memory of a few turns.

The built-in template marks turns with control strings. Control strings inside
texts and roles are broken up with a backslash behind their first character and
backslashes are doubled, which is undone exactly when reading back.

Defined cases: null text and null role are empty; null conv_id is a
conversation of its own; turns with equal numbers are ordered by role and text,
null turns come last; repeated rows are turns of their own. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

WHOLE = 48                 # turns whose whole prefix is rendered
CONTEXT = 4                # turns rendered before a later turn
LOSS_ROLE = "assistant"

# ---- fixed values: control strings of the built-in template and of common others
BEGIN, START, MIDDLE, END = "<s>", "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (BEGIN, "</s>", START, MIDDLE, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}\n", re.S)

PIECES = ("conv_id long, position long, piece string, start long, text_start long, text_end long, loss boolean, "
          "rewrites boolean")


def escape(text: str) -> str:
    """Double backslashes and break up control strings."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo :func:`escape`."""
    return re.sub(r"\\(\\?)", r"\1", text)


def marked(turns: Turns) -> str:
    """The built-in template."""
    if not turns:
        return ""
    return BEGIN + "".join(f"{START}{escape(r)}{MIDDLE}{escape(t)}{END}\n" for r, t in turns)


def common_prefix(a: str, b: str) -> int:
    """Length of the common start of two strings."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def locate(render: Template, before: Turns, turn: tuple[str, str], rendered: str | None = None
           ) -> tuple[str, int, int, int, bool]:
    """``(output, span start, text start, text end, rewrites)`` of one more turn."""
    previous = render(before) if rendered is None else rendered
    output = render([*before, turn])
    start = common_prefix(previous, output)
    one, two = (render([*before, (turn[0], probe)]) for probe in ("\x02", "\x03"))
    text_start = common_prefix(one, two)
    text_end = len(output) - (len(one) - text_start - 1)
    return output, start, text_start, text_end, start < len(previous)


class Conversation:
    """Renders one conversation turn by turn."""

    def __init__(self, render: Template, local: bool = True):
        self._whole = WHOLE if local else math.inf
        self._render, self._turns, self._output, self._length, self.position = render, [], None, 0, 0

    def add(self, role: str, text: str) -> tuple[int, str, int, int, int, bool, bool]:
        """``position, piece, start, text start, text end, loss, rewrites``, in characters."""
        turn, position = (role, text), self.position
        known = self._output if position < self._whole else None
        if known is None:
            known = self._render(self._turns)
        output, start, text_start, text_end, rewrites = locate(self._render, self._turns, turn, known)
        if position >= self._whole:
            shorter = self._turns[1:]
            if self._render([*shorter, turn])[len(self._render(shorter)):] != output[len(known):]:
                raise ValueError("the template looks further back than the rendered context")
        shift = self._length - len(known) if position >= self._whole else 0
        self._turns.append(turn)
        self.position += 1
        if self.position >= self._whole:
            self._turns, self._output = self._turns[-CONTEXT:], None
        else:
            self._output = output
        self._length = len(output) + shift
        return (position, output[start:], start + shift, text_start + shift, text_end + shift,
                role == LOSS_ROLE, rewrites)


def _pieces(batches: Iterator[pa.RecordBatch], render: Template, local: bool) -> Iterator[pa.RecordBatch]:
    now, conversation = None, None
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conversation is None or conv != now:
                now, conversation = conv, Conversation(render, local)
            rows.append((conv, *conversation.add(role or "", text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names) \
            if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read the formatted pieces of each conversation back."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def closed(state):
        conv, n, turns, chars, loss, length = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), length
    state = None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if state is None or r["position"] == 0:
                if state is not None:
                    rows.append(closed(state))
                state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            found = _TURN.findall(r["piece"])
            if r["rewrites"] or len(found) != 1:
                raise ValueError(f"turn {r['position']} of conversation {r['conv_id']} cannot be read back")
            role, text = (unescape(x) for x in found[0])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            if r["loss"]:
                at = r["start"]
                under = unescape(r["piece"][r["text_start"] - at:r["text_end"] - at])
                state[3] += len(under)
                state[4].update(under.encode())
            state[5] = r["start"] + len(r["piece"])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names) \
            if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(state), kinds)], names=names)


def format_conversations(conversations: DataFrame, render: Template = marked, local: bool | None = None) -> DataFrame:
    """One row a turn, in order: the piece it adds to the output, and where it, its text and the loss lie.

    Positions count characters of the conversation's whole output. ``local``: what
    a turn adds depends on a few turns before it at most; only the built-in
    template is taken for such unless the caller says so.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                                 F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(functools.partial(
        _pieces, render=render, local=render is marked if local is None else local), PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted pieces (in the order they come in)."""
    return pieces.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                       "loss_sha256 string, formatted_chars long")
