"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line feed. In texts (and roles) a backslash goes before
each backslash and before each place where ``###`` or ``</turn>`` begins (in roles before ``:`` too), so
control strings of the template never come from a text, and dropping each such backslash restores it.

A batch is assembled as columns: escape positions and segment lengths give cumulative output offsets, the
offsets give a scatter index for each input byte, and all headers, contents and trailers go into one
preallocated buffer, which becomes the data buffer of the Arrow output column.

Defined cases: a null text or role is empty; rows without a conversation id form one conversation; turns
are ordered by turn (nulls first), then role and text; repeated rows are turns of their own; an empty
table gives an empty result; other columns are ignored.

Scale: formatting is a narrow map over rows. Reading back sorts rows by conversation and streams them: a
hash state and counters are carried from batch to batch, so even a conversation that holds a third of all
rows needs one batch of memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import small_batches, text_blocks

OPEN, COLON, CLOSE = b"### ", b": ", b"</turn>\n"
CONTROLS = (b"\\", b"###", b"</turn>")
LOSS_ROLE = "assistant"


def starts_of(buf: np.ndarray, off: np.ndarray, pattern: bytes) -> np.ndarray:
    """Where the pattern begins, as booleans; never across rows."""
    n, k = len(buf), len(pattern)
    hit = np.zeros(n, bool)
    if n >= k:
        at = buf[: n - k + 1] == pattern[0]
        for i in range(1, k):
            at &= buf[i : n - k + 1 + i] == pattern[i]
        hit[: n - k + 1] = at
        if k > 1:
            for i in range(1, k):  # a row ends inside
                cuts = off[1:-1] - i
                hit[cuts[cuts >= 0]] = False
    return hit


def escaped(texts: pa.Array, controls: tuple[bytes, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: bytes, for each the number of backslashes up to and before it, row offsets."""
    for i, j, buf, off in text_blocks(texts):
        esc = np.zeros(len(buf), bool)
        for c in controls:
            esc |= starts_of(buf, off, c)
        yield i, j, buf, np.concatenate([[0], np.cumsum(esc)]), off


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and begin and end of each content in its turn, in bytes."""
    cells: dict[str, bytes] = {}
    for r in set(roles.to_pylist()):
        cells[r] = OPEN + re.sub(rb"(?=\\|:|###|</turn>)", rb"\\", (r or "").encode()) + COLON
    heads = [cells[r] for r in roles.to_pylist()]
    n = len(heads)
    head_len = np.fromiter(map(len, heads), np.int64, n)
    blocks = list(escaped(texts, CONTROLS))
    body_len = np.zeros(n, np.int64)
    for i, j, _, esc, off in blocks:
        body_len[i:j] = np.diff(off) + np.diff(esc[off])
    total = head_len + body_len + len(CLOSE)
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.full(int(at[-1]), ord("\\"), np.uint8)  # what no index below fills is an escape
    head_bytes = np.frombuffer(b"".join(heads), np.uint8)
    head_at = np.concatenate([[0], np.cumsum(head_len)])
    out[np.arange(len(head_bytes)) + np.repeat(at[:-1] - head_at[:-1], head_len)] = head_bytes
    for i, j, buf, esc, off in blocks:
        base = at[i:j] + head_len[i:j] - off[:-1] - esc[off[:-1]]
        out[np.arange(len(buf)) + esc[1:] + np.repeat(base, np.diff(off))] = buf
    close = np.frombuffer(CLOSE, np.uint8)
    out[(at[1:, None] - len(CLOSE) + np.arange(len(CLOSE))).ravel()] = np.tile(close, n)
    formatted = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out))
    return formatted, head_len, head_len + body_len


def format_turns(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, turn, formatted, content_begin, content_end (bytes), loss (assistant), for each row.

    The formatted turns of a conversation, in order and joined by nothing, are its training text.
    """
    small_batches(turns.sparkSession)
    source = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            formatted, begin, end = assemble(b["role"], b["text"])
            loss = pa.array([r == LOSS_ROLE for r in b["role"].to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], formatted.cast(pa.string()), pa.array(begin), pa.array(end), loss], ["conv_id", "turn", "formatted", "content_begin", "content_end", "loss"])

    return source.mapInArrow(run, "conv_id long, turn long, formatted string, content_begin long, content_end long, loss boolean")


TOKEN = re.compile(r"\\(.)|(### )|(: )|(</turn>\n)", re.S)


def plain(text: str) -> str:
    """The text without the template's escapes."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn, read from its characters alone."""
    assert formatted.startswith("### ") and formatted.endswith("</turn>\n")
    role_end = next(m for m in TOKEN.finditer(formatted, 4) if m[3])
    body = formatted[role_end.end() : -len("</turn>\n")]
    return plain(formatted[4 : role_end.start()]), plain(body)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = formatted.select("conv_id", "turn", "formatted", "content_begin", "content_end", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, state = None, None

        def done() -> None:
            n, all_hash, chars, loss_hash, size = state
            rows.append((key, n, all_hash.hexdigest(), chars, loss_hash.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for conv, text, begin, end, loss in zip(*(b[c].to_pylist() for c in ("conv_id", "formatted", "content_begin", "content_end", "loss")), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = read_turn(text)
                raw = content.encode()
                state[0] += 1
                state[1].update(role.encode() + b"\n" + raw + b"\n")
                if loss:  # what the mask covers, cut from the formatted bytes
                    masked = plain(text.encode()[begin:end].decode())
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if len(rows) >= 1000:
                yield flush()
                rows.clear()
        if state is not None:
            done()
        if rows:
            yield flush()

    return ordered.mapInArrow(run, schema)
