"""Conversations of typed content parts as training text, and back."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


START, END = "<|im_start|>", "<|im_end|>"
#: A part's fields; only those of its type are read.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    """Puts one more backslash between < and | so that no control string is left; other text stays as it is."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class PartVisitor:
    """Flattens the parts of one turn into text with ordered placeholders, and records its attachments.

    Each type has a visit method; an unknown or null type is an error, since dropping it would lose content.
    """

    def __init__(self, patch: int = 28, audio_tokens_per_second: float = 25.0, tokens_per_page: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_tokens_per_second, tokens_per_page
        self.attachments: list[dict] = []

    def flatten(self, parts: Iterable[dict] | None) -> str:
        self.attachments = []
        return "".join(self.visit(part) for part in parts or () if part is not None)

    def visit(self, part: dict) -> str:
        method = getattr(self, f"visit_{part['type']}", None)
        if method is None:
            raise ValueError(f"unknown content part: {part['type']}")
        return method(part)

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part: dict) -> str:
        across, down = (math.ceil((part[side] or 0) / self.patch) for side in ("width", "height"))
        return self._attach("image", part, max(1, across) * max(1, down))

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, max(1, math.ceil((part["seconds"] or 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, max(1, part["pages"] or 0) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        nth = len(self.attachments)
        self.attachments.append({"nth": nth, "kind": kind, "ref": part["ref"], "tokens": tokens})
        return f"<|{kind}:{nth}|>"


def format_turn(role: str | None, content: str) -> tuple[str, int, int]:
    """The turn's text, and where in it the content lies."""
    name = escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))
    head = f"{START}{name}\n"
    return f"{head}{content}{END}\n", len(head), len(head) + len(content)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and content (placeholders left in) of a formatted turn."""
    if not formatted.startswith(START) or not formatted.endswith(f"{END}\n"):
        raise ValueError("not a formatted turn")
    head, _, content = formatted[len(START) : -len(END) - 1].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(content)


_TURNS = (
    "conv bigint, turn bigint, formatted string, loss_from int, loss_to int, "
    "attachments array<struct<nth:int,kind:string,ref:string,tokens:bigint>>"
)
_ATTACHMENTS = pa.list_(
    pa.struct([("nth", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
)


def _format(batches: Iterable[pa.RecordBatch], loss_role: str, options: dict) -> Iterator[pa.RecordBatch]:
    visitor = PartVisitor(**options)
    for batch in batches:
        texts, starts, ends, attached = [], [], [], []
        for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            text, start, end = format_turn(role, visitor.flatten(parts))
            texts.append(text)
            starts.append(start if role == loss_role else None)
            ends.append(end if role == loss_role else None)
            attached.append(visitor.attachments)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(starts, pa.int32()),
             pa.array(ends, pa.int32()), pa.array(attached, _ATTACHMENTS)],
            ["conv", "turn", "formatted", "loss_from", "loss_to", "attachments"],
        )


def format_turns(
    turns: DataFrame,
    parts_column: str | None = None,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    loss_role: str = "assistant",
    **options,
) -> DataFrame:
    """One row per turn: (conv, turn, formatted, loss_from, loss_to, attachments).

    A conversation's training text is its rows' `formatted` in the order of (turn, formatted), each a marked
    turn; no row ever holds a conversation, however long. Code points loss_from to loss_to of a `loss_role`
    turn are under the loss mask, null for other turns. `parts_column` holds the content as an array of typed
    parts (`PARTS`); without it the text column is one text part. Attachments have their placeholder's number
    in the turn, their reference and the tokens the placeholder expands to.

    Control strings in texts and roles are escaped reversibly. Null text, parts and roles are empty, rows with
    the same conversation and turn are all kept, a null id is a conversation of its own, a null turn comes
    first, an empty table gives no rows, other columns are not read.
    """
    if parts_column is not None:
        parts = F.col(parts_column)
    else:
        empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
        fields = [F.lit("text").alias("type"), F.col(text_column).alias("text")]
        parts = F.array(F.struct(*fields, *(F.lit(None).cast(kind).alias(name) for name, kind in empty.items())))
    rows = turns.select(F.col(id_column).cast("long"), F.col(turn_column).cast("long"), F.col(role_column), parts)
    return rows.mapInArrow(lambda batches: _format(batches, loss_role, options), _TURNS)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        role, content = parse_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{content}\n".encode())
        if start is not None:
            masked = unescape(formatted[start:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = [
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
]


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows):
        columns = list(zip(*rows)) if rows else [()] * len(_DIGEST)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _DIGEST)], [n for n, _ in _DIGEST])

    now, done = None, []
    for batch in batches:
        for conv, formatted, start, end in zip(*(column.to_pylist() for column in batch.columns)):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            now.add(formatted, start, end)
        if len(done) >= 1000:
            yield batch_of(done)
            done = []
    if now is not None:
        done.append(now.row())
    yield batch_of(done)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars).

    A digest runs over a whole conversation, so its turns meet in one task; they are sorted by Spark and pass
    through one at a time, so memory doesn't grow with the conversation.
    """
    return (
        formatted.repartition("conv")
        .sortWithinPartitions("conv", "turn", "formatted")
        .select("conv", "formatted", "loss_from", "loss_to")
        .mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    )
