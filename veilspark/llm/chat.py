"""Operator 8: chat formatting by a finite-state machine over roles and a declarative template.

A turn becomes segments with a loss flag each: start mark, role, text mark, text, end mark. In roles and texts a
backslash is doubled, and each control string - the template's marks and those it ``guards`` for other templates - gets a
backslash after its first character, so no control string can come from a text, and a single pass from left to right
undoes it. Turn order is checked by the template's machine; breaches are reported (``valid``), not dropped.

Turns are ordered by turn, then role, then text; null roles and texts count as empty, null turns come first, and
rows with a null conv_id are one conversation. Repeated rows are turns each. An empty table gives no rows;
further columns are ignored.

A conversation may hold any share of the rows: its turns are first dealt by (conversation, stretch of turn
numbers), formatted there in order and packed into a few rows, each with the machine's effect from every state;
then these rows are read on in order, one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_task, small_batches

_UNDO = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class Template:
    """Marks, the roles whose texts carry loss, and the machine: state -> role -> state, with accepting states."""

    start: str = "[INST]"
    text: str = "[/INST]"
    answer: str = "[ANSWER]"
    end: str = "</s>"
    guards: tuple = ("<s>",)
    loss_roles: frozenset = frozenset({"assistant"})
    order: dict = field(default_factory=lambda: {"begin": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    begin: str = "begin"
    accepting: frozenset = frozenset({"assistant"})

    def __post_init__(self) -> None:
        controls = (*self.marks(), *self.guards)
        if len(set(self.marks())) < 4 or any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("marks must differ; control strings need two characters or more and no backslash")
        if any(m[0] in c[1:] for m in self.marks() for c in controls):
            raise ValueError("no mark may begin within a control string")  # else text and mark could make one together

    def marks(self) -> tuple[str, str, str, str]:
        return self.start, self.text, self.answer, self.end

    @cached_property
    def _control(self) -> re.Pattern:
        """The first character of each control string, wherever one begins."""
        return re.compile("|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in (*self.marks(), *self.guards)))

    @cached_property
    def _mark(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.marks())))

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    def states(self) -> list[str]:
        return sorted({self.begin, *self.order, *(s for to in self.order.values() for s in to.values())})

    def effect(self, roles: list[str]) -> list[int]:
        """For each state, by number, the state after these roles; -1: out of order."""
        names = self.states()
        out = []
        for state in names:
            for role in roles:
                state = self.order.get(state, {}).get(role)
                if state is None:
                    break
            out.append(names.index(state) if state is not None else -1)
        return out

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        loss = role in self.loss_roles
        return [(self.start + self.escape(role) + (self.answer if loss else self.text), False), (self.escape(text), loss), (self.end, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str, bool]]:
        """(role, text, loss) of each turn, from the formatted text alone."""
        marks = list(self._mark.finditer(formatted))
        if len(marks) % 3 or (marks and (marks[0].start() or marks[-1].end() < len(formatted))):
            raise ValueError("not whole turns")
        for first, middle, last in zip(marks[::3], marks[1::3], marks[2::3]):
            if first[0] != self.start or middle[0] not in (self.text, self.answer) or last[0] != self.end:
                raise ValueError(f"no turn at {first.start()}")
            yield unescape(formatted[first.end() : middle.start()]), unescape(formatted[middle.end() : last.start()]), middle[0] == self.answer


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text) if "\\" in text else text


CHATS = "conv_id long, stretch long, part long, n_turns long, formatted string, loss array<struct<begin: long, end: long>>, effect array<int>"


def formatted(turns: DataFrame, template: Template = Template(), stretch: int = 64) -> DataFrame:
    """Formatted stretches of at most ``stretch`` turns, in the order (conv_id, stretch, part): text, spans under the
    loss mask (code points), and the machine's effect."""
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / stretch).cast("long").alias("stretch"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "turn", "role", "text").select("conv_id", "stretch", "role", "text")

    def pack(key: tuple, part: int, some: list[tuple[str, str]]) -> dict:
        text, spans, at = [], [], 0
        for role, body in some:
            for piece, loss in template.segments(role, body):
                if loss:
                    spans.append({"begin": at, "end": at + len(piece)})
                text.append(piece)
                at += len(piece)
        return {"conv_id": key[0], "stretch": key[1], "part": part, "n_turns": len(some), "formatted": "".join(text), "loss": spans, "effect": template.effect([r for r, _ in some])}

    kind = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("effect", pa.list_(pa.int32()))])

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, some = None, 0, []
        for batch in batches:
            out = []
            for conv, at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if some and ((conv, at) != key or len(some) == stretch):
                    out.append(pack(key, part, some))
                    part, some = part + 1, []
                if (conv, at) != key:
                    key, part = (conv, at), 0
                some.append((role, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if some:
            yield pa.RecordBatch.from_pylist([pack(key, part, some)], kind)

    return dealt.mapInArrow(run, CHATS)


def digests(stretches: DataFrame, template: Template = Template()) -> DataFrame:
    """A row for each conversation, read back from its formatted stretches: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, valid."""
    dealt = stretches.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "part").select("conv_id", "formatted", "loss", "effect")
    names = template.states()
    begin, accepting = names.index(template.begin), {names.index(s) for s in template.accepting}
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    class Reader:
        def __init__(self) -> None:
            self.n = self.loss_chars = self.chars = 0
            self.turns, self.loss, self.state = hashlib.sha256(), hashlib.sha256(), begin

        def add(self, text: str, spans: list[dict], effect: list[int]) -> None:
            for role, body, _ in template.read(text):
                self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                self.n += 1
            for span in spans:
                body = unescape(text[span["begin"] : span["end"]])
                self.loss_chars += len(body)
                self.loss.update(body.encode("utf-8", "surrogatepass"))
            self.chars += len(text)
            self.state = effect[self.state] if self.state >= 0 else -1

        def row(self, conv) -> dict:
            return {"conv_id": conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "valid": self.state in accepting}

    @python_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now = None, None
        for batch in batches:
            out = []
            for conv, text, spans, effect in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv != now:
                    if reader is not None:
                        out.append(reader.row(now))
                    reader, now = Reader(), conv
                reader.add(text, spans, effect)
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([reader.row(now)], kind)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
