"""Chat formatting by columnar byte assembly.

Turns are grouped by conversation and sorted, then read as Arrow batches. The bytes of all headers,
roles and texts of a group of conversations are scattered into one preallocated buffer, whose places
come from segment lengths and their cumulative sums, and which becomes an Arrow string column as is.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. In texts and roles, `<` followed by any number of
backslashes and `|` gets one backslash more, so no control string is left in them; in roles, \\n,
\\r and backslashes are escaped as well. Both are undone by unescape().

Defined results: turns are in order of turn (null first), then role and text; null roles and texts
are empty; rows with null conv_id are one conversation; repeated rows are turns each; an empty table
gives no rows. Turns of roles other than `assistant` are outside the loss. Other columns are not read.
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

START, END = "<|im_start|>", "<|im_end|>"
SCORED = "assistant"
#: Bytes of text gathered before a buffer is made; a longer conversation makes a longer one.
GATHER = 8 << 20
SCHEMA = "conv_id long, formatted string, n_turns long, loss_spans array<long>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def escape_role(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(roles, "\\", "\\\\")
    return escape(pc.replace_substring(pc.replace_substring(roles, "\n", "\\n"), "\r", "\\r"))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), unescape(role))


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each value's length in bytes."""
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(a) else data[:0], np.diff(offsets)


def assemble(group: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[list[int]]]:
    """Formatted strings of runs of equal values in group, their numbers of turns and the code points
    of scored texts in them, as start, end, start, end ..."""
    n = len(group)
    role_bytes, role_len = _bytes(escape_role(roles))
    text_bytes, text_len = _bytes(escape(texts))
    head, mid, tail = (np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n"))
    lengths = np.empty((n, 5), np.int64)
    for k, x in enumerate((len(head), role_len, len(mid), text_len, len(tail))):
        lengths[:, k] = x
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for k, x in ((0, head), (2, mid), (4, tail)):
        out[(starts[:, k, None] + np.arange(len(x))).ravel()] = np.tile(x, n)
    for k, data, size in ((1, role_bytes, role_len), (3, text_bytes, text_len)):
        shift = starts[:, k] - (np.cumsum(size) - size)
        out[np.arange(len(data)) + np.repeat(shift, size)] = data
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    offsets = np.r_[starts[first, 0], ends[-1, -1]]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    # places in code points: bytes that start one, up to there
    points = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]
    conv = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    scored = pc.equal(roles, SCORED).to_numpy(zero_copy_only=False).astype(bool)
    spans: list[list[int]] = [[] for _ in first]
    base = points[offsets[:-1]]
    for i in np.flatnonzero(scored):
        spans[conv[i]] += [int(points[starts[i, 3]] - base[conv[i]]), int(points[ends[i, 3]] - base[conv[i]])]
    return formatted, np.diff(np.r_[first, n]), spans


def _emit(keys: pa.Array, group: np.ndarray, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    formatted, turns, spans = assemble(group, roles, texts)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return pa.record_batch({"conv_id": keys.take(pa.array(first)), "formatted": formatted, "n_turns": pa.array(turns, pa.int64()), "loss_spans": pa.array(spans, pa.list_(pa.int64()))})


def _format(gather: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = ends = 0  # bytes held; rows held before the last conversation, which may go on
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("conv_id")
            change = _changes(keys)
            at = int(change[-1]) if len(change) else 0
            if held and not at and not keys[0].equals(held[-1].column("conv_id")[held[-1].num_rows - 1]):
                ends = rows
            elif at:
                ends = rows + at
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if size >= gather and ends:
                t = pa.Table.from_batches(held)
                yield _parts(t.slice(0, ends))
                held = t.slice(ends).to_batches()
                rows, size, ends = rows - ends, sum(x.nbytes for x in held), 0
        if held:
            yield _parts(pa.Table.from_batches(held))

    return run


def _changes(keys: pa.Array) -> np.ndarray:
    """Rows whose key is not that of the row before."""
    ids = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)
    valid = pc.is_valid(keys).to_numpy(zero_copy_only=False)
    return np.flatnonzero((ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])) + 1


def _parts(t: pa.Table) -> pa.RecordBatch:
    t = t.combine_chunks()
    keys, roles, texts = (t.column(c).combine_chunks() for c in ("conv_id", "role", "text"))
    change = np.zeros(len(keys), np.int64)
    change[_changes(keys)] = 1
    return _emit(keys, np.cumsum(change), roles, texts)


def format_chats(turns: DataFrame, gather: int = GATHER) -> DataFrame:
    """conv_id, formatted, n_turns, loss_spans (code points, start and end of each scored text)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_format(gather), SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises if anything else is in it."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
            turns, said, loss = parse(text), hashlib.sha256(), hashlib.sha256()
            for role, t in turns:
                said.update(f"{role}\n{t}\n".encode())
            n = 0
            for s, e in zip(spans[::2], spans[1::2]):
                t = unescape(text[s:e])
                n += len(t)
                loss.update(t.encode())
            rows.append((len(turns), said.hexdigest(), n, loss.hexdigest(), len(text)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        yield pa.record_batch({"conv_id": b.column("conv_id"), **{n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}})


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted text finds in it."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
