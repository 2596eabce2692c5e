"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation, so a conversation is a run of rows; numpy
computes every segment's length, the running offsets and the scatter indices,
and headers and contents are copied into one preallocated Arrow buffer.

A turn is ``<|turn|>ROLE newline TEXT <|end|> newline``.  In roles and texts a
backslash is doubled and every control string gets a backslash after its first
character, so none occurs there verbatim; in roles a newline is marked as well.
Dropping the backslash of every pair undoes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

TURN, END = "<|turn|>", "<|end|>"
CONTROL = (TURN, END, "<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"
#: Bytes of output whose scatter indices are held at once.
BLOCK = 4 << 20


def escape(text: pa.Array, role: bool = False) -> pa.Array:
    text = pc.replace_substring(text, "\\", "\\\\")
    for mark in CONTROL:
        text = pc.replace_substring(text, mark, f"{mark[0]}\\{mark[1:]}")
    return pc.replace_substring(text, "\n", "\\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


#: A turn's role, to the first newline that no backslash marks.
_ROLE = re.compile(re.escape(TURN) + r"((?:[^\\\n]++|\\.)*+)\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation.  No control
    string occurs in a text, so a text goes to the next END."""
    turns, at = [], 0
    while role := _ROLE.match(formatted, at):
        end = formatted.index(END + "\n", role.end())
        turns.append((unescape(role[1]), unescape(formatted[role.end() : end])))
        at = end + len(END) + 1
    return turns


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = text.cast(pa.large_string())
    _, off, data = text.buffers()
    off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    return off[:-1], np.diff(off), np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """out[to[i] : to[i] + length[i]] = source[start[i] : start[i] + length[i]] for all i."""
    if not len(to):
        return
    total = np.cumsum(length)
    i = 0
    while i < len(to):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK, "right")))
        if j == i + 1:
            out[to[i] : to[i] + length[i]] = source[start[i] : start[i] + length[i]]
        else:
            n = length[i:j]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[i:j], n) + within] = source[np.repeat(start[i:j], n) + within]
        i = j


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations of consecutive turns; ``first`` holds the index
    of each one's first turn.  Also each turn's first and last code point of
    its text, within its conversation."""
    role, text = escape(pc.fill_null(role, ""), role=True), escape(pc.fill_null(text, ""))
    parts = [pa.array([TURN]), role, pa.array(["\n"]), text, pa.array([END + "\n"])]
    n = len(role)
    sources = [_bytes(p) for p in parts]
    lengths = np.stack([np.broadcast_to(s[1], n) for s in sources], axis=1)
    ends = np.cumsum(lengths.ravel())
    to = (ends - lengths.ravel()).reshape(n, len(parts))
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, (start, _, data) in enumerate(sources):
        _scatter(out, to[:, k], data, np.broadcast_to(start, n), lengths[:, k])
    bounds = np.append(to[first, 0], len(out)) if n else np.zeros(1, np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
    chars = np.stack([np.broadcast_to(pc.utf8_length(p).to_numpy(zero_copy_only=False), n) for p in parts], axis=1).astype(np.int64)
    run = np.cumsum(chars.ravel()).reshape(n, len(parts)) if n else np.zeros((0, len(parts)), np.int64)
    base = run[first, 0] - chars[first, 0] if n else run[:0, 0]
    base = np.repeat(base, np.diff(np.append(first, n)))
    return formatted, run[:, 2] - base, run[:, 3] - base


SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.large_string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])
KINDS = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def build(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids = rows.column("conv_id").combine_chunks() if rows.num_rows else pa.array([], pa.int64())
        key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
        first = np.flatnonzero(new)
        role, text = (rows.column(c).combine_chunks() for c in ("role", "text"))
        formatted, start, end = assemble(role, text, first)
        trained = pc.fill_null(pc.equal(role, TRAINED_ROLE), False).to_numpy(zero_copy_only=False)
        bounds = pa.array(np.append(0, np.cumsum(np.add.reduceat(trained.astype(np.int64), first))), pa.int32())
        spans = [pa.ListArray.from_arrays(bounds, pa.array(x[trained])) for x in (start, end)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.diff(np.append(first, len(key)))), formatted, *spans], schema=SCHEMA)

    held: list[pa.Table] = []  # rows of the conversation that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if held:
            a, b = held[-1].column("conv_id")[-1].as_py(), now.column("conv_id")[0].as_py()
            if a != b:
                yield build(pa.concat_tables(held))
                held = []
        ids = now.column("conv_id").combine_chunks()
        last = ids[-1].as_py()
        same = ids.is_null() if last is None else pc.fill_null(pc.equal(ids, last), False)
        cut = now.num_rows - int(pc.sum(same).as_py())  # sorted, so equal ids are a run
        if cut:
            yield build(pa.concat_tables([*held, now.slice(0, cut)]))
            held = []
        held.append(now.slice(cut))
    if held:
        yield build(pa.concat_tables(held))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_start[], loss_end[] (code points of
    each trained text in ``formatted``), one row per conversation.

    Rows go by turn, then role and text; a null turn comes first.  Null roles
    and texts count as empty, rows with a null conv_id are one conversation.
    Repeated rows are repeated turns.  No rows give no rows; other columns are
    ignored.  A conversation is one output value, so its rows meet in one task;
    sorting spills, and only that conversation is held.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(_format, KINDS)
