"""Chat formatting with a grammar round trip.

    conversation = turn*
    turn         = "### " role NEWLINE body NEWLINE "</turn>" NEWLINE
    role, body   = text in which every control string stands behind a backslash

The control strings are `###` and `</turn>`. Every turn is rendered as it is and
read back by the parser below; where the turn recovered is not the source, the
content that conflicts is escaped and the turn is rendered and read again, until
both are identical. Escaping puts one backslash before each control string; the
parser takes one away, so texts that hold escaped control strings survive too.

Turns are rendered where they lie. To read a conversation back, its turns are
brought together in order and the parser runs over their rendered text as over
a stream: it holds a turn at a time, never a conversation. A digest over a whole
conversation is a chain by its definition, so one conversation is read by one
task, however long it is, in bounded memory.

Defined cases. Null role or text counts as empty. A null conv_id is one
conversation; a null turn comes first. Rows of the same turn follow one another
by role and text, repeated rows as often as they occur. A conversation without
assistant turns has an empty loss. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END, ESCAPE = "### ", "</turn>", "\\"
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"###|</turn>")
_ESCAPED = re.compile(r"\\(###|</turn>)")
_TOKEN = re.compile(r"\\(?:###|</turn>)|###|</turn>")


class Conflict(ValueError):
    """The text is not a conversation of the grammar."""


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Parser:
    """Reads rendered text in stretches of any length and gives its turns as they end."""

    rest: str = ""
    seen: int = 0  # of `rest`, up to where it has no end mark
    done: int = 0  # characters of the turns given
    spans: list = field(default_factory=list)

    def feed(self, text: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start, end) of the turns that end here; start and end frame the body in the rendered text."""
        self.rest += text
        out = []
        while True:
            turn, size = self._turn()
            if turn is None:
                return out
            role, body, start, end = turn
            out.append((role, body, self.done + start, self.done + end))
            self.done += size
            self.rest, self.seen = self.rest[size:], 0

    def _turn(self):
        rest = self.rest
        if not rest:
            return None, 0
        if not rest.startswith(HEAD[: len(rest)]):
            raise Conflict("a turn must begin with its head")
        for mark in _TOKEN.finditer(rest, max(self.seen, len(HEAD))):
            if mark[0].startswith(ESCAPE):
                self.seen = mark.end()
                continue
            if mark[0] != END or rest[mark.start() - 1] != "\n":
                raise Conflict("a control string within a turn")
            if mark.end() == len(rest):
                self.seen = mark.start()
                return None, 0
            if rest[mark.end()] != "\n":
                raise Conflict("text behind the end of a turn")
            line = rest.find("\n", len(HEAD))
            if line >= mark.start() - 1:
                raise Conflict("a turn without a body")
            role, body = rest[len(HEAD) : line], rest[line + 1 : mark.start() - 1]
            role = re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else ESCAPE, unescaped(role))
            return (role, unescaped(body), line + 1, mark.start() - 1), mark.end() + 1
        open_ = len(rest) - len(END)  # a mark that begins behind this may go on
        self.seen = max(self.seen, open_ - 1 if open_ > 0 and rest[open_ - 1] == ESCAPE else open_)
        return None, 0

    def close(self) -> None:
        if self.rest:
            raise Conflict("the last turn does not end")


def rendered(role: str, text: str) -> str:
    """The turn's rendered text, which reads back as exactly this turn."""
    line = role.replace(ESCAPE, ESCAPE * 2).replace("\n", ESCAPE + "n")
    for shape in (str, escaped):
        made = f"{HEAD}{shape(line)}\n{shape(text)}\n{END}\n"
        parser = Parser()
        try:
            turns = parser.feed(made)
            parser.close()
        except Conflict:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return made
    raise Conflict("a turn that does not read back")


def formatted(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, rendered: a conversation is its rows' rendered texts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rendered(a.as_py(), b.as_py()) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.append_column("rendered", pa.array(made, pa.string()))

    plain = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return plain.mapInArrow(run, "conv_id long, turn long, role string, text string, rendered string")


class _Reader:
    """Digests of one conversation as its turns come in."""

    def __init__(self, conv_id):
        self.conv_id, self.parser = conv_id, Parser()
        self.turns = self.chars = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, piece: str) -> None:
        self.chars += len(piece)
        found = self.parser.feed(piece)
        if [t[:2] for t in found] != [(role, text)]:
            raise Conflict("a conversation that does not read back")
        for name, body, _, _ in found:
            self.turns += 1
            self.all.update(f"{name}\n{body}\n".encode())
            if name == LOSS_ROLE:
                self.loss_chars += len(body)
                self.loss.update(body.encode())

    def row(self) -> tuple:
        self.parser.close()
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, names = None, [x.split()[0] for x in DIGEST.split(", ")]
    for batch in batches:
        rows = []
        for conv_id, role, text, piece in zip(*(batch.column(i) for i in range(4))):
            conv_id = conv_id.as_py()
            if reader is None or reader.conv_id != conv_id:
                if reader is not None:
                    rows.append(reader.row())
                reader = _Reader(conv_id)
            reader.add(role.as_py(), text.as_py(), piece.as_py())
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    if reader is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, reader.row()))], pa.schema([pa.field(n, pa.string() if "sha" in n else pa.int64()) for n in names]))


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, what the parser recovers from its rendered text: see `DIGEST`."""
    dealt = made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text", "rendered").mapInArrow(_read, DIGEST)
