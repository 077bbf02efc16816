"""Operator 4: chat formatting with typed content parts.

A visitor flattens the parts of a message (text, image, audio, document) into one body: text is escaped,
the others become numbered placeholders whose references and expanded token counts are recorded beside it.
`format_turns` makes one row a turn; the turns of a conversation in order are its formatted text. `read_back`
parses that text again and needs the turns of a conversation in order, not together: it streams over sorted
rows, so even a conversation with a third of all rows takes bounded memory (its one digest is sequential).

Template: `### role: body </turn>` and a line feed. Inside roles and bodies `\\`, `#` and `<` get a backslash,
in roles also `:` and line feeds; so no control string (`###`, `</turn>`, `<|`) can occur unescaped.

Null text, role or parts count as empty; a part of unknown type is a document; a null conv_id is a
conversation of its own. Repeated rows stay, ordered by (turn, role, text), nulls first. Only the named
columns are read, so further columns can't clash. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,uri:string,tokens:bigint>"
TURNS = (
    "conv_id long, turn long, role string, formatted string, "
    "attachments array<struct<placeholder:string,type:string,uri:string,tokens:bigint>>, "
    "loss array<struct<start:bigint,length:bigint>>, tokens bigint"
)
#: Tokens that a part expands to where it doesn't say.
EXPANDS = {"image": 256, "audio": 128, "document": 512}

_escape = re.compile(r"[\\#<]")
_escape_role = re.compile(r"[\\#<:\n]")
_unescape = re.compile(r"\\(.)", re.DOTALL)
_turn = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<#]|\\.|<\|[a-z]+ \d+\|>)*) </turn>\n", re.DOTALL)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1", text)


class Visitor:
    """Flattens the parts of one message, in order."""

    def __init__(self, start: int):
        self.at, self.body, self.text_spans, self.attachments, self.tokens = start, [], [], [], 0

    def add(self, text: str) -> int:
        self.body.append(text)
        self.at += len(text)
        return len(text)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        start = self.at
        if length := self.add(_escape.sub(r"\\\g<0>", part.get("text") or "")):
            self.text_spans.append({"start": start, "length": length})

    def attach(self, part: dict, kind: str) -> None:
        mark = f"<|{kind} {len(self.attachments)}|>"
        tokens = EXPANDS[kind] if part.get("tokens") is None else part["tokens"]
        self.add(mark)
        self.attachments.append({"placeholder": mark, "type": kind, "uri": part.get("uri"), "tokens": tokens})
        self.tokens += tokens

    def visit_image(self, part: dict) -> None:
        self.attach(part, "image")

    def visit_audio(self, part: dict) -> None:
        self.attach(part, "audio")

    def visit_document(self, part: dict) -> None:
        self.attach(part, "document")


def text_parts(text) -> "F.Column":
    """A text column as the parts of a message."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("tokens")))


def format_turns(messages: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each message (conv_id, turn, role, parts): its formatted text, attachments, expanded tokens,
    and as loss mask the spans of its texts where the role is one to learn from."""

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.to_pylist():
                head = f"### {_escape_role.sub(r'\\\g<0>', m['role'] or '')}: "
                v = Visitor(len(head))
                for part in m["parts"] or []:
                    v.visit(part or {})
                rows.append(m | {"formatted": f"{head}{''.join(v.body)} </turn>\n", "attachments": v.attachments, "loss": v.text_spans if m["role"] in learn_from else [], "tokens": v.tokens})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    kept = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(f"array<{PART}>"))
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("attachments", pa.list_(pa.struct([("placeholder", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("tokens", pa.int64())])
    return kept.mapInArrow(run, TURNS)


class Digest:
    """What is read back from one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, spans: list[dict]) -> None:
        at = 0
        while m := _turn.match(formatted, at):
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.turns += 1
            at = m.end()
        if at != len(formatted):
            raise ValueError(f"conversation {self.conv_id} can't be read back at {at}")
        for s in spans:
            text = unescape(formatted[s["start"] : s["start"] + s["length"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_back(turns: DataFrame) -> DataFrame:
    """A row for each conversation of `format_turns`, from the formatted texts and loss masks alone."""

    def run(batches):
        now = None
        for batch in batches:
            rows = []
            for m in batch.to_pylist():
                if now is None or now.conv_id != m["conv_id"]:
                    rows += [now.row()] if now else []
                    now = Digest(m["conv_id"])
                now.read(m["formatted"], m["loss"])
            yield pa.RecordBatch.from_pylist(rows, schema=out)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema=out)

    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = turns.select("conv_id", "turn", "role", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
