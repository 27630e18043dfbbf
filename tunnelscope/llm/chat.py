r"""Chat formatting with a grammar that reads back what was written.

    conversation = turn*
    turn         = "### " role ": " text "</turn>" newline
    role, text   = any characters, where a backslash takes the next character literally;
                   "### " and "</turn>" don't occur in a text unless one stands before them,
                   and ": " and newlines don't in a role

Each turn is rendered as it is, parsed again and compared with its source. Only if they differ, its control strings are escaped, and if they
still differ, its backslashes too; this last form always reads back.

A conversation is written as parts of bounded size in order, so a very long one is no large cell, and it is read by a parser that
keeps only what a turn needs.

Defined cases: null texts and roles are empty; turns that tie are in order of role and text; a null turn comes first; rows without
a conversation id are a conversation of their own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .scans import partitions_of

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
# Characters of a part of a formatted conversation.
PART_CHARS = 1 << 18

_STEP = re.compile(r"\\(.)|(### )|(</turn>)|(: )|(\n)", re.DOTALL)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


class ParseError(ValueError):
    pass


def parse_turn(text: str, at: int) -> tuple[str, str, int]:
    """Role, text and end of the turn that begins at ``at``."""
    if not text.startswith(OPEN, at):
        raise ParseError("a turn must open")
    begin = at + len(OPEN)
    role = None
    for m in _STEP.finditer(text, begin):
        if m[1] is not None:
            continue
        if role is None:
            if m[4] is None:
                raise ParseError("a role must end")
            role, begin = _UNESCAPE.sub(r"\1", text[begin : m.start()]), m.end()
        elif m[2] is not None:
            raise ParseError("a turn opens inside a turn")
        elif m[3] is not None:
            if not text.startswith(CLOSE, m.start()):
                raise ParseError("a turn must close")
            return role, _UNESCAPE.sub(r"\1", text[begin : m.start()]), m.start() + len(CLOSE)
    raise ParseError("a turn must close")


def _escaped(s: str, level: int) -> str:
    if level == 2:
        s = s.replace("\\", "\\\\")
    return re.sub(r"### |</turn>", lambda m: "\\" + m[0], s) if level else s


def _escaped_role(s: str, level: int) -> str:
    if level == 2:
        s = s.replace("\\", "\\\\")
    return re.sub(r"### |</turn>|: |\n|:\Z", lambda m: "\\" + m[0], s) if level else s


def render_turn(role: str, text: str) -> str:
    """The turn in the mildest escaping that reads back."""
    for level in (0, 1, 2):
        out = f"{OPEN}{_escaped_role(role, level)}{COLON}{_escaped(text, level)}{CLOSE}"
        try:
            if parse_turn(out, 0) == (role, text, len(out)):
                return out
        except ParseError:
            pass
    raise ParseError("the last form always reads back")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Parts (conv_id, part, formatted) of the formatted conversations of (conv_id, turn, role, text)."""
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(partitions_of(turns), "conv_id").sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size, part, started = None, [], 0, 0, False
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["conv_id", "part", "formatted"])

        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if started and conv != current:
                    out.append((current, part, "".join(held)))
                    held, size, part = [], 0, 0
                elif size >= PART_CHARS:
                    out.append((current, part, "".join(held)))
                    held, size, part = [], 0, part + 1
                current, started = conv, True
                held.append(render_turn(role, text))
                size += len(held[-1])
            if out:
                yield packed()
        if started:
            out.append((current, part, "".join(held)))
            yield packed()

    return rows.mapInArrow(run, "conv_id bigint, part int, formatted string")


def read_conversations(formatted: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Parses formatted parts: per conversation conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The loss mask covers the text of each turn of ``loss_role``, as it was before escaping.
    """
    rows = formatted.repartition(partitions_of(formatted), "conv_id").sortWithinPartitions("conv_id", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def read(self, text: str) -> None:
            at = 0
            self.chars += len(text)
            while at < len(text):
                role, body, at = parse_turn(text, at)
                self.turns += 1
                self.all.update(f"{role}\n{body}\n".encode())
                if role == loss_role:
                    self.loss_chars += len(body)
                    self.loss.update(body.encode())

        def row(self) -> tuple:
            return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                if state is None or conv != state.conv:
                    if state is not None:
                        out.append(state.row())
                    state = State(conv)
                state.read(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(state.row(), types, strict=True)], names)

    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def round_trip(turns: DataFrame) -> DataFrame:
    """Formats, writes to the shared folder, and reads back."""
    return read_conversations(cut(format_conversations(turns), "formatted"))
