"""Chat formatting by a finite-state machine over roles and a declarative template.

The turns of a conversation pass through the machine in order. It says whether the order of roles is
allowed, and emits text segments: the mark that opens a turn, its text, the mark that closes it. Each segment
says whether the loss is taken on it. Control strings inside a text are escaped, reversibly, so `parse` finds
exactly the turns that went in.

Conversations are streamed: rows are sorted by conversation and turn, and a task holds one turn and the state
of the machine, never a whole conversation. A digest over a conversation is sequential, so one
conversation is read by one task.

Nulls: a null text or role is empty; an empty role is allowed nowhere. A null conversation id is a conversation of
its own. Turns with equal numbers go by role, then text. An empty table gives no segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.llm.text import sliced

ROWS = 1024


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles whose text bears the loss, and the moves allowed between roles."""

    opens: str = "<|im_start|>"
    names: str = "\n"
    closes: str = "<|im_end|>"
    ends: str = "\n"
    loss: tuple[str, ...] = ("assistant",)
    start: tuple[str, ...] = ("system", "user")
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()
_ESCAPED = re.compile(r"<(\\*)\|")
_PLAIN = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Put a backslash into every `<|`, and one more into every `<\\|`, so no mark can occur in the result."""
    return _ESCAPED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on the line of its mark, so line ends and bars are spelled out."""
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


class Machine:
    """The state of one conversation: its last role, and the first thing wrong with it."""

    def __init__(self, template: Template):
        self.t, self.role, self.problem = template, None, None

    def step(self, role: str) -> None:
        allowed = self.t.start if self.role is None else self.t.moves.get(self.role, ())
        if self.problem is None and role not in allowed:
            self.problem = f"{role or 'no role'} after {self.role or 'the start'}"
        self.role = role

    def end(self) -> str | None:
        return self.problem or (None if self.role in self.t.final else f"ends with {self.role}")


SEGMENTS = "conv_id bigint, segment bigint, text string, loss boolean, problem string"


def segments(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments of every conversation in order; the last one of a conversation, which is empty, bears its problem.

    Rows of a conversation stay together and in order within their partition.
    """
    blank = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")}
    sorted_ = turns.select("conv_id", "turn", blank["role"], blank["text"]).repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, at = None, None, 0
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)],
                names=["conv_id", "segment", "text", "loss", "problem"])

        for batch in sliced(batches, ROWS):
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if machine is None or conv != now:
                    if machine is not None:
                        rows.append((now, at, "", False, machine.end()))
                    now, machine, at = conv, Machine(template), 0
                machine.step(role)
                opening = template.opens + escape_role(role) + template.names
                for part, loss in ((opening, False), (escape(text), role in template.loss), (template.closes + template.ends, False)):
                    rows.append((conv, at, part, loss, None))
                    at += 1
            yield out()
            rows = []
        if machine is not None:
            rows.append((now, at, "", False, machine.end()))
            yield out()

    return sorted_.mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, problem string"


class Reader:
    """Parses the formatted text of one conversation as it comes, and digests its turns."""

    def __init__(self, conv: int | None, template: Template):
        self.conv, self.t = conv, template
        self.text, self.turns, self.all = "", 0, 0
        self.said, self.lost, self.lost_chars = hashlib.sha256(), hashlib.sha256(), 0
        self.pending = ""  # text under the loss mask that may end within an escape

    def feed(self, text: str, loss: bool) -> None:
        self.all += len(text)
        self.text += text
        if loss:
            self.pending += text
        elif self.pending:
            plain = unescape(self.pending)
            self.lost.update(plain.encode())
            self.lost_chars += len(plain)
            self.pending = ""
        end = self.t.closes + self.t.ends
        while (at := self.text.find(end)) >= 0:
            turn, self.text = self.text[:at], self.text[at + len(end):]
            role, said = turn.removeprefix(self.t.opens).split(self.t.names, 1)
            self.said.update(f"{unescape_role(role)}\n{unescape(said)}\n".encode())
            self.turns += 1

    def row(self, problem: str | None) -> tuple:
        self.feed("", False)
        return (self.conv, self.turns, self.said.hexdigest(), self.lost_chars, self.lost.hexdigest(), self.all, problem)


def parse(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Read segments back: for each conversation its turns, what bears the loss, and digests of both.

    Turns come from the marks in the joined text, not from the borders of segments. Takes what
    `segments` returns, whose rows are in order within their partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in sliced(batches, ROWS):
            rows = []
            for conv, at, text, loss, problem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == 0:
                    reader = Reader(conv, template)
                reader.feed(text, loss)
                if text == "" and at % 3 == 0:
                    rows.append(reader.row(problem))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=[x.split()[0] for x in DIGESTS.split(", ")])

    return formatted.mapInArrow(run, DIGESTS)
