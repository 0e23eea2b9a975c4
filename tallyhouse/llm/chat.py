"""Chat formatting by columnar byte assembly.

Rows (conv_id, turn, role, text) become marked-up conversations with a loss mask over the assistants' texts.  Every
turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts each ``<`` and ``[`` is followed by an inserted
backslash, so no control string can appear, and taking those backslashes out again restores the text; a line break in
a role becomes ``<n``.

Segment lengths, their running offsets and scatter positions are computed in numpy for a whole Arrow batch, and the
headers, texts and footers are copied into one buffer allocated beforehand.

Defined cases: null text and null role count as empty; null conv_id is one conversation of its own; null turn comes
first; equal turns are ordered by role and text, and repeated rows are all kept; an empty table gives no rows.  Other
columns of the input are ignored.  A conversation longer than an Arrow batch comes in several parts, numbered in
order, so memory is bounded by a batch whatever the length of a conversation.
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

from .words import ranges

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
#: Texts are cut into slices of about this many bytes before assembly, as Arrow's string offsets have 32 bits.
SLICE_BYTES = 64 << 20

PARTS = "conv_id bigint, part_no int, formatted string, loss array<struct<start:int, stop:int>>"
DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint")

TURN = re.compile(re.escape(OPEN) + rb"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, "<", "<\\"), "[", "[\\")


def restored(text: bytes) -> bytes:
    return text.replace(b"<\\", b"<").replace(b"[\\", b"[")


def restored_role(role: bytes) -> bytes:
    return restored(role.replace(b"<n", b"\n"))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other, and the length of each."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return body[offsets[0]:offsets[-1]], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The marked-up bytes of all turns, each turn's end, and the place and length of its text."""
    names = pc.replace_substring(escaped(roles), "\n", "<n")
    names_body, names_len = column_bytes(names)
    body, body_len = column_bytes(escaped(texts))
    lengths = len(OPEN) + names_len + 1 + body_len + len(CLOSE)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text_at = starts + len(OPEN) + names_len + 1
    for i, byte in enumerate(OPEN):
        out[starts + i] = byte
    out[ranges(starts + len(OPEN), names_len)] = names_body
    out[text_at - 1] = ord("\n")
    out[ranges(text_at, body_len)] = body
    for i, byte in enumerate(CLOSE):
        out[text_at + body_len + i] = byte
    return out, ends, text_at, body_len


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = int(sizes[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def format_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, parts of conversations out."""
    last, part = (), 0
    for whole in batches:
        for batch in sliced(whole):
            ids = batch.column("conv_id")
            roles = pc.fill_null(batch.column("role"), "").cast(pa.large_string())
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
            out, ends, text_at, text_len = assemble(roles, texts)
            known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (null[1:] != null[:-1])])
            final = np.r_[first[1:], batch.num_rows] - 1
            offsets = np.r_[0, ends[final]]
            parts = np.zeros(len(first), np.int32)
            if (bool(null[0]), int(known[0])) == last:
                parts[0] = part + 1
            last, part = (bool(null[-1]), int(known[-1])), int(parts[-1])
            spoken = np.flatnonzero(pc.equal(roles, "assistant").to_numpy(zero_copy_only=False))
            owner = np.searchsorted(first, spoken, "right") - 1
            start = text_at[spoken] - offsets[owner]
            spans = pa.StructArray.from_arrays(
                [pa.array(start.astype(np.int32)), pa.array((start + text_len[spoken]).astype(np.int32))], ["start", "stop"])
            held = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(first)))].astype(np.int32)
            formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first)), pa.array(parts), formatted, pa.ListArray.from_arrays(pa.array(held), spans)],
                ["conv_id", "part_no", "formatted", "loss"])


class Reading:
    """What has been read back of one conversation so far."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: bytes, spans: list[dict]) -> None:
        self.chars += len(formatted.decode("utf-8"))
        for role, text in TURN.findall(formatted):
            self.turns += 1
            self.said.update(restored_role(role) + b"\n" + restored(text) + b"\n")
        for span in spans:
            text = restored(formatted[span["start"]:span["stop"]])
            self.loss_chars += len(text.decode("utf-8"))
            self.loss.update(text)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered parts in, one row of digests per conversation out."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    now, done = None, []
    for batch in batches:
        for conv_id, formatted, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), batch.column("loss")):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = Reading(conv_id)
            now.add(formatted.as_buffer().to_pybytes(), spans.as_py())
        if len(done) >= 1000:
            yield table(done)
            done = []
    if now is not None:
        done.append(now.row())
    if done:
        yield table(done)


def format_chats(turns: DataFrame) -> DataFrame:
    """Parts (conv_id, part_no, formatted, loss); ``loss`` holds byte ranges of the part.  The parts of a conversation
    lie in one partition in order.  Turns are hashed by conversation, as their order fixes the output."""
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(format_parts, PARTS)


def read_chats(parts: DataFrame) -> DataFrame:
    """Turns and masked texts read back from the parts of ``format_chats``, as digests per conversation."""
    return parts.mapInArrow(read_parts, DIGESTS)


def read_stored_chats(parts: DataFrame) -> DataFrame:
    """The same for parts that were written and lie in any order."""
    return read_chats(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part_no"))
