r"""Chat formatting from event logs.

A log has rows (conv_id, seq, part, message, op, role, text), in which ``op`` is

* ``start``: a new message of ``role`` whose text so far is ``text``;
* ``delta``: ``text`` is appended to the message (a streamed piece);
* ``edit``: the message's text is replaced by ``text``;
* ``regenerate``: the message's text is dropped; new deltas follow.

The log is dealt out by conversation, sorted by (seq, message, part) inside the partition, and
folded as a stream: a task holds one message at a time, however long the conversation is. A
message's events must be neighbours in that order. Messages are rendered as

    ``<|role|>`` newline, text, ``<|end|>`` newline

with ``\`` and ``<`` inside roles and texts (``|`` inside roles too) written with a ``\`` before, so that no text can
look like the template and everything can be read back. Loss falls on assistant texts only.

Nulls: a null text is empty, a null role is the empty role, null conversation ids form one
conversation of their own. Unknown ops are errors. Repeated events are repeated events:
``start`` rows given twice make two messages. Rows of equal (conv_id, turn) are ordered by role and text. Other columns are not
read and may have any names; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL, IN_ROLES = re.compile(r"[\\<]"), re.compile(r"[\\<|]")
ESCAPED = re.compile(r"\\([\\<|])")
TURN = re.compile(r"<\|((?:[^\\<|]|\\[\\<|])*)\|>\n((?:[^\\<]|\\[\\<])*)<\|end\|>\n")

ESCAPE = r"\\\g<0>"

#: A streamed piece has at most so many characters.
PIECE = 256


def escape(text: str) -> str:
    return SPECIAL.sub(ESCAPE, text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message's segment and where its escaped text starts and ends in it."""
    head, body = f"<|{IN_ROLES.sub(ESCAPE, role)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def read_back(segment: str) -> list[tuple[str, str]]:
    """(role, text) of every message of rendered text; an error if it is anything else."""
    out, at = [], 0
    while at < len(segment):
        m = TURN.match(segment, at)
        if m is None:
            raise ValueError(f"no message at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def event_log(turns: DataFrame) -> DataFrame:
    """The log behind finished ``turns`` (conv_id, turn, role, text).

    Users and others start with the first letters of their text and edit the message to the whole text. Assistants
    start empty, stream a first piece, regenerate, and stream the whole text in pieces.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    event = lambda op, x: F.struct(F.lit(op).alias("op"), x.alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / PIECE) - 1, F.lit(0)).cast("int")), lambda k: event("delta", F.substring(text, k * PIECE + 1, F.lit(PIECE))))
    streamed = F.concat(F.array(event("start", F.lit("")), event("delta", F.substring(text, 1, PIECE)), event("regenerate", F.lit(""))), pieces)
    events = F.when(role == "assistant", streamed).otherwise(F.array(event("start", F.substring(text, 1, 8)), event("edit", text)))
    message = F.struct(F.xxhash64(role, text), F.monotonically_increasing_id())  # repeated rows stay apart
    return turns.select("conv_id", F.col("turn").alias("seq"), message.alias("message"), role.alias("role"), F.posexplode(events).alias("part", "event")).select("conv_id", "seq", "part", "message", "event.op", "role", "event.text")


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, position, role, text) of the finished messages, from sorted events."""
    conv, at, role, text = None, -1, None, []
    for c, op, r, t in rows:
        if op == "start":
            if role is not None:
                yield conv, at, role, "".join(text)
            at = at + 1 if at >= 0 and c == conv else 0
            conv, role, text = c, r or "", [t or ""]
        elif op == "delta":
            text.append(t or "")
        elif op == "edit":
            text = [t or ""]
        elif op == "regenerate":
            text = []
        else:
            raise ValueError(f"unknown op {op}")
    if role is not None:
        yield conv, at, role, "".join(text)


def format_messages(log: DataFrame) -> DataFrame:
    """One row per final message, in order within a partition and whole conversations in one.

    conv_id, position, role, segment, loss_start, loss_end. The formatted conversation is the
    concatenation of its segments by position; the loss mask is [loss_start, loss_end) within
    the segment, empty where no loss falls.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (x for part in parts for x in zip(part["conv_id"], part["op"], part["role"], part["text"]))
        out = []
        for conv, at, role, text in fold(rows):
            segment, a, b = render(role, text)
            out.append((conv, at, role, segment, a if role == "assistant" else 0, b if role == "assistant" else 0))
            if len(out) == 2000:
                yield frame(out)
                out = []
        yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "position", "role", "segment", "loss_start", "loss_end"])

    kind = log.schema["conv_id"].dataType
    order = ["conv_id", "seq", "message", "part"]
    dealt = log.repartition("conv_id").sortWithinPartitions(*order)
    done = dealt.select(F.col("conv_id").cast("string"), "op", "role", "text").mapInPandas(run, "conv_id string, position bigint, role string, segment string, loss_start bigint, loss_end bigint")
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))


def digests(messages: DataFrame) -> DataFrame:
    """What the rendered conversations say, read back from their segments.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for part in parts:
            out = []
            for conv, at, segment, a, b in zip(part["conv_id"], part["position"], part["segment"], part["loss_start"], part["loss_end"]):
                if at == 0:
                    if now:
                        out.append(ended(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(segment[a:b])
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(segment)
            yield frame(out)
        if now:
            yield frame([ended(now)])

    def ended(x: list) -> tuple:
        return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = messages.schema["conv_id"].dataType
    told = messages.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(run, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return told.withColumn("conv_id", F.col("conv_id").cast(kind))
