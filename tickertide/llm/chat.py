"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, pos long, segment string, loss boolean, state string, in_order boolean"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles are trained on, and which turn orders are allowed.

    ``moves`` maps (state, role) to the next state; a role without a move leaves the state as
    it is and marks the turn as out of order.  A conversation is valid if all its turns are in
    order and it ends in an accepting state.
    """

    headers: dict[str, str] = field(
        default_factory=lambda: {
            "system": "### System: ",
            "user": "### User: ",
            "assistant": "### Assistant: ",
        }
    )
    other: str = "### Other {role}: "
    end: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)
    # Strings that may not stand in a text unmarked; the escape character comes first.
    controls: tuple[str, ...] = ("\\", "###", "</turn>")

    def step(self, state: str, role: str) -> tuple[str, bool]:
        after = self.moves.get((state, role))
        return (state, False) if after is None else (after, True)


CHAT = Template()


def escaped(text: Column, template: Template = CHAT, more: tuple[str, ...] = ()) -> Column:
    """``text`` with the escape character before every control string."""
    for control in (*template.controls, *more):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def unescape(text: str, template: Template = CHAT) -> str:
    if "\\" not in text:
        return text
    marks = "|".join(re.escape(c) for c in (*template.controls, ":"))
    return re.sub(rf"\\({marks})", lambda m: m[1], text)


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Text segments of all conversations, in order within each partition.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored.  Every turn gives
    three segments: header, text, end mark; ``loss`` is true for the texts of trained roles
    alone.  Turns are ordered by ``turn`` (nulls first), ties by role and text; repeated rows
    are turns of their own.  Null texts and roles are empty; rows with a null ``conv_id`` are
    one conversation; an empty table gives no rows.  The machine walks the sorted rows with one
    state in memory, so that a conversation of any length needs no more than its longest turn;
    a conversation is one task, also that of all null ids.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    header = F.replace(F.lit(template.other), F.lit("{role}"), escaped(role, template, (":",)))
    for name, text in template.headers.items():
        header = F.when(role == name, F.lit(text)).otherwise(header)
    # Ties go by the plain text, so texts are escaped after the sort.
    rows = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "turn", "role", header.alias("header"), escaped(F.col("text"), template).alias("body"))
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, pos = object(), "start", 0
        for batch in batches:
            out: list[tuple] = []
            ids, roles, headers, bodies = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
            for conv, name, head, body in zip(ids, roles, headers, bodies, strict=True):
                if conv != now:
                    now, state, pos = conv, "start", 0
                state, fits = template.step(state, name)
                trained = name in template.trained
                for text, loss in ((head, False), (body, trained), (template.end, False)):
                    out.append((conv, pos, text, loss, state, fits))
                    pos += 1
            yield _batch(out, SEGMENT_TYPES)

    return rows.mapInArrow(walk, SEGMENTS)


SEGMENT_TYPES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("pos", pa.int64()),
        ("segment", pa.string()),
        ("loss", pa.bool_()),
        ("state", pa.string()),
        ("in_order", pa.bool_()),
    ]
)
DIGEST_TYPES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("valid", pa.bool_()),
    ]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


class Reader:
    """Reads formatted text back, piece by piece, into (role, text) turns."""

    def __init__(self, template: Template):
        self.template, self.pending = template, ""
        before, after = (re.escape(x) for x in template.other.split("{role}"))
        known = "|".join(re.escape(h) for h in template.headers.values())
        self.names = {h: r for r, h in template.headers.items()}
        marks = "|".join(re.escape(c) for c in (*template.controls, ":"))
        piece = rf"(?:\\(?:{marks})|(?!{re.escape(template.end)})[^\\])*"
        role = rf"(?:\\(?:{marks})|[^\\:])*"
        self.turn = re.compile(
            rf"(?P<known>{known})(?P<a>{piece}){re.escape(template.end)}"
            rf"|{before}(?P<role>{role}){after}(?P<b>{piece}){re.escape(template.end)}",
            re.S,
        )

    def feed(self, text: str, complete: bool) -> Iterator[tuple[str, str]]:
        self.pending += text
        if not complete:
            return
        at = 0
        while at < len(self.pending):
            m = self.turn.match(self.pending, at)
            if m is None:
                raise ValueError("formatted text that can't be read back")
            body = m["a"] if m["known"] else m["b"]
            role = self.names[m["known"]] if m["known"] else unescape(m["role"], self.template)
            yield role, unescape(body, self.template)
            at = m.end()
        self.pending = ""


def chat_digests(segments: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, read back from ``format_chats`` without another shuffle.

    The hashes are fed segment by segment; no conversation is held as a whole.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv = False, None
        reader = Reader(template)
        n = loss_chars = chars = 0
        turns, losses = hashlib.sha256(), hashlib.sha256()
        state, fits = "start", True

        def result() -> tuple:
            valid = fits and state in template.accepting
            return conv, n, turns.hexdigest(), loss_chars, losses.hexdigest(), chars, valid

        for batch in batches:
            done: list[tuple] = []
            columns = (batch.column(k).to_pylist() for k in range(6))
            for key, pos, text, loss, after, ok in zip(*columns, strict=True):
                if not started or key != conv:
                    if started:
                        done.append(result())
                    started, conv, n, loss_chars, chars = True, key, 0, 0, 0
                    turns, losses, fits = hashlib.sha256(), hashlib.sha256(), True
                chars += len(text)
                state, fits = after, fits and ok
                if loss:
                    plain = unescape(text, template)
                    loss_chars += len(plain)
                    losses.update(plain.encode())
                for role, said in reader.feed(text, pos % 3 == 2):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
            yield _batch(done, DIGEST_TYPES)
        if started:
            yield _batch([result()], DIGEST_TYPES)

    return segments.mapInArrow(fold, DIGESTS)
