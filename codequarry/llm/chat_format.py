r"""Chat formatting with a grammar that gives back what was put in.

    formatted := turn*
    turn      := "### " name ": " text " </turn>\n"

A control string is "</turn>" or a run of three or more "#". One that belongs to a text or a role name carries a
backslash more than it had, so a run of backslashes before a control string always tells one from
the other; a name's colons carry one too. A turn is rendered plainly first and read back by the
parser; if that does not give the same role and text, its conflicting parts are escaped, until it
does.

Turns of one conversation meet in one task, in order, as a stream: digests grow turn by turn, so
a conversation of any length needs the memory of one turn. Null roles and texts are empty; turns
that tie are ordered by role, then text. Rows without a conversation id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import partitions, small_batches

HEAD, END = "### ", " </turn>\n"
#: Role as rendered for the usual roles; any other is rendered as it is.
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {name: role for role, name in NAMES.items()}
#: The role whose text carries loss.
TRAINED = "assistant"

_CONTROL = re.compile(r"\\*(?:#{3,}|</turn>)")
_ESCAPED = re.compile(r"\\(\\*(?:#{3,}|</turn>))")
_COLON, _NAME_COLON = re.compile(r"\\*:"), re.compile(r"\\(\\*:)")


class NotATurn(ValueError):
    """The text does not follow the grammar."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _name(role: str, escaped: bool) -> str:
    if role in NAMES:
        return NAMES[role]
    if not escaped:
        return role
    # a role spelled like a rendered name is told apart by a colon of its own
    name = _COLON.sub(lambda m: "\\" + m[0], escape(role))
    return name + "\\:" if role in ROLES or role.endswith((":", "\\")) or not role else name


def _role(name: str) -> str:
    if name in ROLES:
        return ROLES[name]
    if name.endswith("\\:"):
        name = name[:-2]
    return unescape(_NAME_COLON.sub(r"\1", name))


def _control(text: str, start: int) -> int:
    """Place of the next control string without a backslash before it, or -1."""
    return next((m.start() for m in _CONTROL.finditer(text, start) if m[0][0] != "\\"), -1)


def _colon(text: str, start: int) -> int:
    """Place of the colon that ends a name, or -1."""
    at = text.find(": ", start)
    while at > start and text[at - 1] == "\\":
        at = text.find(": ", at + 1)
    return at


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first, end) per turn; formatted[first:end] is the text as rendered."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise NotATurn(at)
        name_at = at + len(HEAD)
        colon, end = _colon(formatted, name_at), _control(formatted, name_at)
        first, last = colon + 2, end - 1
        if colon < 0 or last < first or formatted[last:end + 8] != END:
            raise NotATurn(at)
        turns.append((_role(formatted[name_at:colon]), unescape(formatted[first:last]), first, last))
        at = end + 8
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped only where reading it back gives something else."""
    tries = ((_name(role, n), escape(text) if t else text)
             for n, t in ((False, False), (False, True), (True, False), (True, True)))
    for name, body in tries:
        turn = f"{HEAD}{name}: {body}{END}"
        try:
            if [x[:2] for x in parse(turn)] == [(role, text)]:
                return turn
        except NotATurn:
            pass
    raise NotATurn(role)


class Reader:
    """Digests of one conversation, from its rendered turns as they come."""

    def __init__(self):
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str) -> None:
        for role, text, _, _ in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == TRAINED:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self, key: int | None) -> tuple:
        return (key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [render(r.as_py() or "", t.as_py() or "")
               for r, t in zip(batch.column("role"), batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array(out, pa.string())],
            ["conv_id", "turn", "formatted"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*done), kinds)],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    reader, last = None, None
    for batch in batches:
        done = []
        for key, turn in zip(batch.column(0).to_pylist(), batch.column(1)):
            if reader is None or key != last:
                if reader:
                    done.append(reader.row(last))
                reader, last = Reader(), key
            reader.read(turn.as_py())
        if done:
            yield rows(done)
    if reader:
        yield rows([reader.row(last)])


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted): every turn rendered; a conversation is its turns, joined."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                                F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"),
                                F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rendered, "conv_id long, turn long, formatted string")


def read_back(turns: DataFrame) -> DataFrame:
    """Turn counts and digests per conversation, from the rendered turns alone."""
    return (turns.repartition(partitions(turns.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted")
            .mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, "
                                    "loss_chars long, loss_sha256 string, formatted_chars long"))
