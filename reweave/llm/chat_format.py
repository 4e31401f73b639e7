"""Chat formatting by event-sourced reconstruction.

A log of events (delta, edit, regenerate) is dealt out by conversation and, within it, by message, sorted by sequence
number and folded into final messages (events of one message change no other, so a conversation need not be one group), which are rendered with a template and a loss mask. Deltas append; an edit replaces all that was
said so far; a regeneration empties the message, so that what follows starts afresh.

Messages fold and render on their own, so one very long conversation spreads over many tasks. Only the digest of a
whole conversation, which is sequential by nature, streams through one task, holding one message at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reweave.llm.common import own_columns

TURN, END = "### ", "</turn>"
_PLAIN = {"\\": "\\\\", "###": "\\h", END: "\\e"}
_BACK = {v: k for k, v in _PLAIN.items()} | {"\\c": ":"}
_FIND = re.compile(r"\\|###|</turn>")
_FIND_BACK = re.compile(r"\\[\\hec]")
_READ = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.S)


def escape(text: str) -> str:
    """`text` without any control string; `unescape` gives the text back."""
    return _FIND.sub(lambda m: _PLAIN[m[0]], text)


def unescape(text: str) -> str:
    return _FIND_BACK.sub(lambda m: _BACK[m[0]], text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted, and where its text begins and ends in it."""
    head = f"{TURN}{escape(role).replace(':', chr(92) + 'c')}: "
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, or of a part of it that ends after a turn."""
    return [(unescape(m[1]), unescape(m[2])) for m in _READ.finditer(formatted)]


def fold(events: DataFrame) -> DataFrame:
    """Final messages from events (conv_id, turn, message, seq, kind, role, text).

    Returns conv_id, turn, message, role, text. Null text and role count as empty; unknown kinds count as deltas;
    the role is that of the first event that names one. Messages that an event only empties stay, with empty text.
    A null conv_id is a conversation of its own; empty logs give no rows.
    """
    placed = (
        events.select("conv_id", "turn", "message", "seq", "kind", "role", "text")
        .repartition("conv_id", "message")
        .sortWithinPartitions("conv_id", "message", "seq", "kind", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        done: list[tuple] = []
        role, parts = "", []
        for batch in batches:
            for conv, turn, message, _, kind, who, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key is None or (conv, message) != (key[0], key[2]):
                    if key is not None:
                        done.append((*key, role, "".join(parts)))
                    key, role, parts = (conv, turn, message), "", []
                role = role or who or ""
                if kind in ("edit", "regenerate"):
                    parts = []
                if kind != "regenerate":
                    parts.append(text or "")
            if done:
                yield _rows(done)
                done = []
        if key is not None:
            yield _rows([(*key, role, "".join(parts))])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "turn", "message", "role", "text"])

    return placed.mapInArrow(run, "conv_id long, turn long, message long, role string, text string")


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """Each message as a piece of its formatted conversation: conv_id, turn, message, formatted, loss_start, loss_end.

    Pieces joined in order of (turn, message) are the conversation. The loss mask covers [loss_start, loss_end) of
    the piece, which is empty for roles other than `learn`. Ids of any kind pass through, null ones too; no messages give
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [render_turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            mine = [r == learn for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "turn", "message")),
                    pa.array([t[0] for t in turns], pa.string()),
                    pa.array([t[1] if m else 0 for t, m in zip(turns, mine)], pa.int64()),
                    pa.array([t[2] if m else 0 for t, m in zip(turns, mine)], pa.int64()),
                ],
                ["conv_id", "turn", "message", "formatted", "loss_start", "loss_end"],
            )

    return messages.mapInArrow(
        run, "conv_id long, turn long, message long, formatted string, loss_start long, loss_end long"
    )


def rows_as_events(conversations: DataFrame, *, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """A table with one row for each turn as a log: each row is one message, said by one delta. Rows that share a
    turn are separate messages, in order of role and text."""
    rows = own_columns(conversations, conv_id=conv, turn=turn, role=role, text=text)
    return rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.monotonically_increasing_id().alias("message"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("delta").alias("kind"),
        "role",
        "text",
    )


def rows_as_log(conversations: DataFrame, *, piece: int = 400, **columns: str) -> DataFrame:
    """A table with one row for each turn as a log of what a client would have streamed: a draft that an assistant's row
    regenerates and another's row edits, and then the text in deltas of `piece` characters.

    Folding gives the rows back: repeated rows and rows that share a turn stay separate messages.
    """
    whole = rows_as_events(conversations, **columns)
    text, c = F.coalesce("text", F.lit("")), F.col
    many = F.ceil(F.char_length(text) / piece).cast("int")
    event = lambda seq, kind, said: F.struct(seq.cast("long").alias("seq"), kind.alias("kind"), said.alias("text"))
    deltas = F.transform(F.sequence(F.lit(1), many), lambda i: event(i + 1, F.lit("delta"), F.substring(text, (i - 1) * piece + 1, F.lit(piece))))
    renewed = F.when(c("role") == "assistant", F.lit("regenerate")).otherwise(F.lit("edit"))
    start = F.array(event(F.lit(0), F.lit("delta"), F.lit("draft")), event(F.lit(1), renewed, F.lit("")))
    events = F.concat(start, F.when(many > 0, deltas).otherwise(F.slice(start, 1, 0)))
    return whole.select("conv_id", "turn", "message", "role", F.explode(events).alias("e")).select(
        "conv_id", "turn", "message", "e.seq", "e.kind", "role", "e.text"
    )


def digest(pieces: DataFrame) -> DataFrame:
    """What a formatted conversation says, read back from it: a row for each conversation, one of them for a null conv_id; no
    pieces give no rows."""
    order = ["conv_id", "turn", "formatted", "message"]
    placed = pieces.repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, said, loss, count, loss_chars, chars = False, None, None, None, 0, 0, 0

        def row() -> pa.RecordBatch:
            values = [conv, count, said.hexdigest(), loss_chars, loss.hexdigest(), chars]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            out = []
            for c, piece, a, b in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if not started or c != conv:
                    if started:
                        out.append(row())
                    started, conv, count, loss_chars, chars = True, c, 0, 0, 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in read_turns(piece):
                    count += 1
                    said.update(f"{role}\n{text}\n".encode())
                learnt = unescape(piece[a:b])
                loss.update(learnt.encode())
                loss_chars += len(learnt)
                chars += len(piece)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if started:
            yield row()

    return placed.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """Events to formatted pieces: `fold`, then `render`. Empty logs give no rows."""
    return render(fold(events))
