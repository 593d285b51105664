"""Chat formatting from an event log: fold each conversation's events into final messages, then render them.

A log's rows are (conv_id, position, seq, kind, role, text): ``position`` is the message's place in its conversation and
``seq`` orders events. Kinds: ``message`` opens a message, ``delta`` appends to it, ``edit`` replaces its text,
``regenerate`` clears it (later deltas fill it again), ``delete`` takes it away.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: The template's own marks, and other templates' control strings that texts must not smuggle in either. Fixed values.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A control string with any number of backslashes behind its first character.
STUFFED = re.compile("|".join(rf"({re.escape(c[0])})(\\*)(?={re.escape(c[1:])})" for c in CONTROL))
SEGMENT = re.compile(re.escape(OPEN) + "([^\n]*)\n(.*)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """Puts one more backslash behind the first character of whatever is, but for backslashes there, a control string."""
    return STUFFED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """Takes that backslash away again."""
    return STUFFED.sub(lambda m: m[0].removesuffix("\\"), text)


def render(role: str, text: str) -> str:
    return OPEN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + BREAK + escape(text) + CLOSE


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    role, text = SEGMENT.fullmatch(segment).groups()
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(text)


def format_chats(events: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, turn, role, segment, loss_start, loss_end), by conversation and in order within its partition.

    A conversation's segments in order of turn (from 0) make up its formatted text. loss_start and loss_end are code
    points within the segment that the loss covers: the text of trained roles, nothing for others (both null).

    Events are dealt by conversation and sorted by (position, seq), so the fold holds one message at a time however long
    the conversation is. Null texts and roles are empty. A null seq comes first; equal ones are ordered by kind (message
    first), role and text. A null position comes before all others, a null conv_id is a conversation of its own. What
    changes a message that was never opened opens it. An unknown kind fails. Extra columns aren't read.
    """
    small_batches(events.sparkSession)
    order = F.when(F.col("kind") == "message", 0).otherwise(1)
    dealt = events.select("conv_id", "position", "seq", "kind", "role", "text").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("position").asc_nulls_first(), F.col("seq").asc_nulls_first(), order, "role", "text")
    kind = events.schema["conv_id"].dataType
    fields = ["conv_id", "turn", "role", "segment", "loss_start", "loss_end"]

    def run(batches):
        conv, place, turn, message = object(), None, 0, None
        out: list = []

        def close():
            nonlocal message, turn
            if message is not None:
                role, text = message[0], "".join(message[1])
                segment = render(role, text)
                start = len(segment) - len(escape(text)) - len(CLOSE) if role in trained else None
                out.append((conv, turn, role, segment, start, None if start is None else len(segment) - len(CLOSE)))
                turn += 1
            message = None

        def batch_of(like):
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], like), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:4]), *(pa.array(c, pa.int64()) for c in columns[4:])], names=fields)

        like = None
        for batch in batches:
            like = batch.schema.types[0]
            for c, position, _, what, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                role, text = role or "", text or ""
                if c != conv:
                    close()
                    conv, place, turn = c, position, 0
                elif position != place:
                    close()
                    place = position
                if what == "message":
                    close()
                    message = [role, [text]]
                elif what == "delete":
                    message = None
                elif what in ("delta", "edit", "regenerate"):
                    message = message or [role, []]
                    if what == "delta":
                        message[1].append(text)
                    else:
                        message[1] = [text] if what == "edit" else []
                else:
                    raise ValueError(f"unknown kind of event: {what!r}")
            yield batch_of(like)
        close()
        if out:
            yield batch_of(like)

    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, turn bigint, role string, segment string, loss_start bigint, loss_end bigint")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats()'s rows, one row a conversation, hashed segment by segment."""
    small_batches(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, state, like, out = object(), None, None, []

        def close():
            if state is not None:
                n, turns, chars, loss, size = state
                out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def batch_of():
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            out.clear()
            kinds = [like, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            like = batch.schema.types[0]
            for conv, _, _, segment, start, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(segment)
                if start is not None:
                    masked = unescape(segment[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            yield batch_of()
        close()
        if out:
            yield batch_of()

    # No exchange in between: format_chats() leaves each conversation in one partition and in order.
    return formatted.mapInArrow(run, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: every row opens a message, with its text, at its turn."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.select("conv_id", F.col("turn").alias("position"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one with control strings, and gives digests of what is read back, one row each."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    return digests(format_chats(as_events(turns.unionByName(extra))))
