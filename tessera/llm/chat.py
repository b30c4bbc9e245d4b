"""Chat formatting (10): conversations as marked-up text that a deterministic parser reads back.

Method, a grammar round trip. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Each rendered turn
is parsed again; where the parser doesn't give back the same role and text, the content conflicts
with the grammar and is escaped once more, until it does. In the grammar a body holds no ``<|``;
``<``, backslashes and ``|`` in a row stand for the same with one backslash less. In a role, a
backslash and a line end are written with a backslash too.

Defined cases. Null role or text: empty. Null conv_id: one conversation of its own. Rows of the same
turn follow each other by role, then text; repeated rows are turns of their own. A conversation of
any length is streamed turn by turn, never gathered: its digest needs its turns in order, so one
task reads them, with memory for one batch. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PIECES = "conv_id long, number long, piece string, loss_start long, loss_stop long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, where the written body starts and stops) of each turn; None if it isn't in the
    grammar. Left to right, without a choice anywhere."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            return None
        line = formatted.find("\n", at)
        stop = formatted.find("<|", line)
        if line < 0 or stop < 0 or not formatted.startswith(f"{END}\n", stop) or "<|" in formatted[at + len(START) : line]:
            return None
        role, body = formatted[at + len(START) : line], formatted[line + 1 : stop]
        turns.append((unescape_role(unescape(role)), unescape(body), line + 1, stop))
        at = stop + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The written turn that reads back as this role and text, and where its body stands."""
    as_role, body = role, text
    while True:
        piece = f"{START}{as_role}\n{body}{END}\n"
        turns = parse(piece)
        if turns is not None and [t[:2] for t in turns] == [(role, text)]:
            return piece, turns[0][2], turns[0][3]
        if (written := (escape(escape_role(role)), escape(text))) == (as_role, body):
            raise ValueError("a turn that no escape makes readable")
        as_role, body = written


def _streamed(batches, columns):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _flush(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def pieces(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The written turns of each conversation in order (number from 0), and the loss mask of each:
    characters [loss_start, loss_stop) of the piece, null where the turn has no loss.

    Turns are written before the shuffle, wherever they lie; the shuffle brings a conversation's
    pieces together in order."""
    written_schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_stop", pa.int64())])

    def write(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                piece, start, stop = render(role, text)
                rows.append((conv, turn, role, text, piece, *((start, stop) if role == loss_role else (None, None))))
            if rows:
                yield _flush(rows, written_schema)

    def number(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("number", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_stop", pa.int64())])
        last, n = (), 0
        for batch in batches:
            ids, numbers = batch.column("conv_id").to_pylist(), []
            for conv in ids:
                last, n = (conv, 0) if last != conv else (last, n + 1)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(numbers, pa.int64()), *(batch.column(c) for c in ("piece", "loss_start", "loss_stop"))], schema=schema)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    written = turns.mapInArrow(write, "conv_id long, turn long, role string, text string, piece string, loss_start long, loss_stop long")
    return written.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(number, PIECES)


def digests(written: DataFrame) -> DataFrame:
    """What reading each conversation's pieces gives back; ``written``: as pieces() returns them,
    each conversation's in order within a partition."""

    def read(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, done = None, []

        def close():
            conv, n, turns, chars, loss, total = now
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for conv, piece, start, stop in _streamed(batches, ("conv_id", "piece", "loss_start", "loss_stop")):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if len(done) >= 5000:
                    yield _flush(done, schema)
                    done = []
            for role, text, _, _ in parse(piece):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            if start is not None:
                under = unescape(piece[start:stop])
                now[3] += len(under)
                now[4].update(under.encode())
            now[5] += len(piece)
        if now is not None:
            close()
        if done:
            yield _flush(done, schema)

    return written.mapInArrow(read, DIGESTS)
