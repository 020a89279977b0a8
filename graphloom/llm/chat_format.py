"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative template emits segments with loss flags.

Control strings inside texts are escaped reversibly: between `<` and `|` one backslash is put before those that stand there already, so that no
text holds the beginning of a control string; in a role also backslashes and line ends are escaped. Turns stream through: nothing of a
conversation is held but the machine's state, two running digests and the turn that is being read back, so that a conversation may have any number of turns.

Defined cases: a null text or role is empty; rows are taken by turn, then role, then text, nulls first, and repeated rows are turns of their own; a
conversation whose order the machine refuses is formatted all the same and marked with the first turn refused (from 0; -1: none); rows without conv_id are one conversation
without an id; an empty table gives nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, tidy

OPENING, HELD = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return HELD.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Template:
    """begin and end of a turn; which roles' texts are learned; which role may follow which ("" is the beginning)."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user", "tool"}), "tool": frozenset({"assistant", "tool"})})


CHATML = Template()


class Machine:
    """State: the role before. Each turn gives its segments and whether it may stand there."""

    def __init__(self, template: Template) -> None:
        self.template, self.state = template, ""

    def turn(self, role: str, text: str) -> tuple[list[tuple[str, bool]], bool]:
        t = self.template
        fits = role in t.follows.get(self.state, ())
        self.state = role
        return [(t.begin + escape_role(role) + t.after_role, False), (escape(text), role in t.learned), (t.end, False)], fits


class Reader:
    """Reads turns and learned texts back from emitted segments alone, as they come. It holds what isn't a whole turn yet."""

    def __init__(self, template: Template) -> None:
        self.template, self.formatted = template, ""
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, segment: str, learned: bool) -> None:
        self.chars += len(segment)
        if learned:
            under = unescape(segment)
            self.loss.update(under.encode())
            self.loss_chars += len(under)
        self.formatted += segment
        if segment == self.template.end:
            turns, at = read_turns(self.formatted, self.template)
            for role, text in turns:
                self.turns.update(f"{role}\n{text}\n".encode())
            self.n += len(turns)
            self.formatted = self.formatted[at:]


def read_turns(formatted: str, template: Template) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of each whole turn of a formatted text, and where the rest begins."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(template.begin, at):
            raise ValueError(f"no turn begins at {at}")
        role_end = formatted.find(template.after_role, at)
        end = formatted.find(template.end, role_end + len(template.after_role)) if role_end >= 0 else -1
        if end < 0:
            break
        out.append((unescape_role(formatted[at + len(template.begin) : role_end]), unescape(formatted[role_end + len(template.after_role) : end])))
        at = end + len(template.end)
    return out, at


def read_back(formatted: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of each turn of a whole formatted text."""
    turns, at = read_turns(formatted, template)
    if at < len(formatted):
        raise ValueError(f"the turn at {at} doesn't end")
    return turns


class Digest:
    """A conversation turn by turn: its segments, and what a reader of these finds."""

    def __init__(self, conv_id: int | None, template: Template) -> None:
        self.conv_id, self.machine, self.reader, self.turn, self.refused = conv_id, Machine(template), Reader(template), 0, None

    def add(self, role: str, text: str) -> str:
        segments, fits = self.machine.turn(role, text)
        if not fits and self.refused is None:
            self.refused = self.turn
        self.turn += 1
        for segment, learned in segments:
            self.reader.add(segment, learned)
        return "".join(s for s, _ in segments)

    def row(self) -> tuple:
        r = self.reader
        if r.formatted:
            raise ValueError(f"conversation {self.conv_id} doesn't read back: {len(r.formatted)} characters are no turn")
        return self.conv_id, r.n, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars, self.refused is None, -1 if self.refused is None else self.refused


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, refused_turn long"
ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("refused_turn", pa.int64())])


def ordered(conversations: DataFrame) -> DataFrame:
    """Whole conversations in each partition, their turns in order."""
    rows = small_batches(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digests(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation, read back from its formatted text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now else []
                    now = Digest(conv_id, template)
                now.add(role, text)
            if done:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), ARROW, strict=True)], schema=ARROW)
        if now:
            yield pa.record_batch([pa.array([c], f.type) for c, f in zip(now.row(), ARROW, strict=True)], schema=ARROW)

    return ordered(conversations).mapInArrow(tidy(of), RESULT)


def segments(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, turn, segment, text, loss): the formatted texts themselves, in pieces, with the loss flag of each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine = object(), None
        for batch in batches:
            rows = []
            for conv_id, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if conv_id != now:
                    now, machine = conv_id, Machine(template)
                rows += [(conv_id, turn, k, s, loss) for k, (s, loss) in enumerate(machine.turn(role, text)[0])]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()), strict=True)], names=["conv_id", "turn", "segment", "text", "loss"])

    return ordered(conversations).mapInArrow(tidy(of), "conv_id long, turn long, segment int, text string, loss boolean")
