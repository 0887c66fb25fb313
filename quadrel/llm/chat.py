"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive
prefixes of a conversation are rendered; what a prefix adds to the one before is the turn's
span, and rendering the last turn twice more, with two texts that share no character, tells
where its text stands in the span. A template whose longer output does not begin with the
shorter one rewrites history, which is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
# Two texts without a common character: what their renderings share surrounds the text.
PROBES = ("\u0001", "\u0002")


@dataclass(frozen=True)
class Span:
    """A turn in the output: the piece it adds, where its text stands in that piece, and how
    many characters of what came before the template rewrote (0: none)."""

    role: str
    piece: str
    text_start: int
    text_end: int
    rewritten: int


def spans(turns: Iterable[Turn], render: Callable[[list[Turn]], str]) -> Iterator[Span]:
    """Spans of successive turns, found from outputs alone.

    Every prefix of the conversation is rendered once, and twice more with a probe for its
    last text; each output is compared with the one before. Outputs are compared a block at a
    time, so what is quadratic in the turns is the template's own work and memory reads.
    """
    prefix: list[Turn] = []
    before = ""
    for turn in turns:
        prefix.append(turn)
        after = render(prefix)
        kept = len(before) if after.startswith(before) else common_start(before, after)
        shown = []
        for probe in PROBES:
            prefix[-1] = (turn[0], probe)
            shown.append(render(prefix))
        prefix[-1] = turn
        start = common_start(*shown)
        tail = common_start(shown[0][start:][::-1], shown[1][start:][::-1])
        yield Span(turn[0], after[kept:], max(0, start - kept), max(0, len(after) - tail - kept), len(before) - kept)
        before = after


def common_start(a: str, b: str) -> int:
    """Length of the common beginning of two strings, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # equal up to low, different before high
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BracketTemplate:
    """User turns in instruction brackets, answers closed by an end mark, system turns and
    other roles in brackets of their own. Control strings inside texts are escaped by a
    backslash after their first character, and backslashes are doubled, so any text can be
    read back and none can pose as a mark."""

    # The marks.
    KNOWN = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
    OTHER = ("<s>[ROLE] ", "\n", " [/ROLE]")
    CONTROL = re.compile(r"</?s>|\[/?INST\]|\[/?ROLE\]|<</?SYS>>")
    ESCAPED = re.compile(r"\\(.)", re.S)

    @classmethod
    def escape(cls, text: str) -> str:
        return cls.CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    @classmethod
    def unescape(cls, text: str) -> str:
        return cls.ESCAPED.sub(r"\1", text)

    @classmethod
    def marks(cls, role: str) -> tuple[str, str]:
        if role in cls.KNOWN:
            return cls.KNOWN[role]
        # Role names have no line end: "\n" is the mark's, so one inside a name is spelled \n.
        name = cls.escape(role).replace("\n", "\\\n")
        return cls.OTHER[0] + name + cls.OTHER[1], cls.OTHER[2]

    def __init__(self):
        self.known: dict[Turn, str] = {}  # turns of the conversation in hand, as rendered

    def __call__(self, turns: list[Turn]) -> str:
        if len(turns) == 1:
            self.known.clear()
        out = []
        for turn in turns:
            if turn not in self.known:
                start, end = self.marks(turn[0])
                self.known[turn] = start + self.escape(turn[1]) + end
            out.append(self.known[turn])
        return "".join(out)

    @classmethod
    def read(cls, piece: str) -> Turn:
        """Role and text of one turn's piece of the output; raises if it is none."""
        for role, (start, end) in cls.KNOWN.items():
            if piece.startswith(start) and piece.endswith(end) and len(piece) >= len(start) + len(end):
                return role, cls.unescape(piece[len(start) : len(piece) - len(end)])
        head, tail = cls.OTHER[0], cls.OTHER[2]
        if piece.startswith(head) and piece.endswith(tail):
            body = piece[len(head) : len(piece) - len(tail)]
            cut = re.search(r"(?:[^\\\n]|\\.)*", body, re.S).end()
            if body[cut : cut + 1] == "\n":
                return cls.unescape(body[:cut]), cls.unescape(body[cut + 1 :])
        raise ValueError("not a turn of this template")


def sorted_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text), whole conversations in a partition, in the order of turns.

    Null roles and texts are empty. Rows of equal turn numbers (null first) are ordered by
    role and text, so repeated rows keep a defined place. A conversation is a sequence that a
    template renders as a whole, so one task reads it.
    """
    rows = conversations.select(
        F.col(key).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _first(batches) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The key's Arrow type, whatever it is, and all batches."""
    batches = iter(batches)
    first = next(batches, None)
    return (None, iter(())) if first is None else (first.column(0).type, chain([first], batches))


def _streamed(batches) -> Iterator[tuple[object, Iterator[Turn]]]:
    """Conversations one after the other; a conversation's turns must be used up first."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)

    for conv, own in groupby(rows(), key=lambda r: r[0]):
        yield conv, ((r[1], r[2]) for r in own)


def format_turns(conversations: DataFrame, render: Callable[[list[Turn]], str] | None = None, loss_roles: tuple[str, ...] = ("assistant",), **names) -> DataFrame:
    """The formatted conversations, a row a turn: (conv_id, n, role, piece, loss_start,
    loss_end, rewritten). The pieces of a conversation, in the order of n, are its output
    where ``rewritten`` is 0; loss_start and loss_end are code points of the piece, null for
    turns outside the loss mask. Whole prefixes are rendered, whatever the template says of
    itself, so a task holds one conversation."""
    render = render or BracketTemplate()

    def run(batches):
        out: list[tuple] = []
        key_type, batches = _first(batches)
        for conv, turns in _streamed(batches):
            for n, s in enumerate(spans(turns, render)):
                masked = s.role in loss_roles
                out.append((conv, n, s.role, s.piece, s.text_start if masked else None, s.text_end if masked else None, s.rewritten))
                if len(out) >= 2000:
                    yield record(out, key_type)
                    out = []
        if out:
            yield record(out, key_type)

    def record(rows, key_type):
        kinds = [key_type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n", "role", "piece", "loss_start", "loss_end", "rewritten"])

    ordered = sorted_turns(conversations, **names)
    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, n long, role string, piece string, loss_start long, loss_end long, rewritten long")


def format_digests(conversations: DataFrame, **names) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per
    conversation, read back from the bracket template's output.

    A turn is read from the piece of output that it added; the loss text is what stands
    under the mask, unescaped. Raises where the template rewrites history. Every prefix of a
    conversation is rendered; a task holds one conversation at a time.
    """

    def run(batches):
        template = BracketTemplate()
        rows = []
        key_type, batches = _first(batches)
        for conv, turns in _streamed(batches):
            said, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for s in spans(turns, template):
                if s.rewritten:
                    raise ValueError(f"the template rewrites history in conversation {conv}")
                role, text = template.read(s.piece)
                said.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    masked = template.unescape(s.piece[s.text_start : s.text_end])
                    loss.update(masked.encode())
                    chars += len(masked)
                n, size = n + 1, size + len(s.piece)
            rows.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), size))
            if len(rows) >= 5000:
                yield record(rows, key_type)
                rows = []
        if rows:
            yield record(rows, key_type)

    def record(rows, key_type):
        kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = sorted_turns(conversations, **names)
    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
