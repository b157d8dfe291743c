"""Chat formatting by columnar byte assembly (operator 8).

Rows of (conversation, turn, role, text) become ChatML-style records. For each batch of turns
the lengths of all segments are computed, their cumulative offsets give every segment's
place, and numpy scatter indices copy headers and contents into one preallocated Arrow
buffer; no string is built turn by turn.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``\\`` becomes
``\\\\``, ``<|`` becomes ``<\\|``, and in roles a line feed becomes ``\\n``: no content can hold
a control string, and ``parsed`` restores every content exactly.

A conversation is a sequence of pieces, each with the turns of one bounded batch, so that a
conversation of any length is formatted with bounded memory. The loss mask of a piece lists
the byte ranges of the assistant's texts.

Turns go by turn (nulls first), then role, then text; repeated rows are all kept; null roles
and texts count as empty; ids have any type, and a null conversation id is a conversation of its
own. A very long text is a batch, and a piece, of its own. Only the four columns are read, so other
columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices

#: The template (fixed values).
START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
ASSISTANT = "assistant"


def escaped(values: pa.Array, role: bool = False) -> pa.Array:
    """Contents as they stand in a record."""
    out = pc.replace_substring(pc.fill_null(values, ""), "\\", "\\\\")
    out = pc.replace_substring(out, "<|", "<\\|")
    return pc.replace_substring(out, "\n", "\\n") if role else out


def unescaped(content: str) -> str:
    """What ``escaped`` was given."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], content)


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content bytes of a string array, and the first byte and the length of each value."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
    """Copy data[first : first + length] to out[to :] for all segments at once."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    step = np.arange(total) - np.repeat(ends - length, length)
    out[np.repeat(to, length) + step] = data[np.repeat(first, length) + step]


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """One buffer with every turn formatted; each turn's first byte (and the end), and the byte range of its text."""
    (r, r_first, r_len), (t, t_first, t_len) = _bytes(escaped(roles, role=True)), _bytes(escaped(texts))
    turn_len = len(START) + r_len + len(MIDDLE) + t_len + len(END)
    first = np.concatenate([[0], np.cumsum(turn_len)])
    buffer = pa.allocate_buffer(int(first[-1]))
    out = np.frombuffer(buffer, np.uint8)
    at_role = first[:-1] + len(START)
    at_text = at_role + r_len + len(MIDDLE)
    for fixed, at in ((START, first[:-1]), (MIDDLE, at_role + r_len), (END, at_text + t_len)):
        out[at[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _scatter(out, at_role, r, r_first, r_len)
    _scatter(out, at_text, t, t_first, t_len)
    return buffer, first, np.stack([at_text, at_text + t_len], 1)


def formatted(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, piece, n_turns, formatted, loss: the pieces of every conversation.

    One shuffle, by conversation; the rows stream through sorted. ``loss`` is an array of
    (first, last) byte ranges of ``formatted``, one for each assistant turn, in order.
    """
    read = chats.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ranges = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, piece = object(), 0
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                conv = part.column("conv").to_pylist()
                starts = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]] + [len(conv)]
                buffer, first, text = assembled(part.column("role"), part.column("text"))
                spoken = pc.fill_null(pc.equal(part.column("role"), ASSISTANT), False).to_numpy(zero_copy_only=False)
                bounds = first[starts]
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), buffer])
                pieces, loss = [], []
                for a, b in zip(starts, starts[1:], strict=False):
                    piece = piece + 1 if conv[a] == before else 0
                    before = conv[a]
                    pieces.append(piece)
                    loss.append([{"first": x, "last": y} for x, y in (text[a:b][spoken[a:b]] - first[a]).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv").take(pa.array(starts[:-1])), pa.array(pieces, pa.int32()), pa.array(np.diff(starts), pa.int32()), values.cast(pa.large_string()).cast(pa.string()), pa.array(loss, ranges)],
                    ["conv", "piece", "n_turns", "formatted", "loss"],
                )

    in_order = read.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    loss = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    kinds = [("piece", T.IntegerType()), ("n_turns", T.IntegerType()), ("formatted", T.StringType()), ("loss", loss)]
    return in_order.mapInArrow(run, T.StructType([in_order.schema["conv"], *[T.StructField(*k) for k in kinds]]))


def parsed(piece: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted piece."""
    turns = piece.split(START.decode())[1:]
    heads = (turn.removesuffix(END.decode()).split("\n", 1) for turn in turns)
    return [(unescaped(role), unescaped(text)) for role, text in heads]


def digests(pieces: DataFrame) -> DataFrame:
    """What each conversation says, read back from its pieces alone, in the order ``formatted`` gives them.

    conv, n_turns, turns_sha256 (of role, line feed, text, line feed for each turn),
    loss_chars and loss_sha256 (of all text under the loss mask), formatted_chars.
    """
    kinds = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def row() -> list:
            conv, n, turns, chars, loss, size = state
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        kind = pa.null()
        for batch in batches:
            done, kind = [], batch.schema.field("conv").type
            for r in batch.to_pylist():
                if state is None or r["piece"] == 0:
                    if state is not None:
                        done.append(row())
                    state = [r["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parsed(r["formatted"])
                state[1] += len(turns)
                state[2].update("".join(f"{a}\n{b}\n" for a, b in turns).encode())
                raw = r["formatted"].encode()
                spoken = "".join(unescaped(raw[x["first"] : x["last"]].decode()) for x in r["loss"])
                state[3] += len(spoken)
                state[4].update(spoken.encode())
                state[5] += len(r["formatted"])
            if done:
                yield out(done, kind)
        if state is not None:
            yield out([row()], kind)

    def out(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], ["conv", *kinds])

    return pieces.mapInArrow(run, T.StructType([pieces.schema["conv"], *[T.StructField(*k) for k in kinds.items()]]))
