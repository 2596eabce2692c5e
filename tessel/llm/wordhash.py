"""Words of whole Arrow text columns as 64-bit hashes, by numpy.

A chunk of documents is one byte buffer: separators give word bounds, running
sums of a polynomial over the bytes give every word's hash at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of documents handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 20
#: Bytes hashed at once inside a chunk; bounds the eight-byte arrays.
PIECE = 1 << 18

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, PIECE + 4096), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table_of(separators: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(separators)] = True
    return t


#: Space and the five ASCII controls beside it.
BLANKS = table_of(bytes([0x20, *range(0x09, 0x0E)]))
#: All ASCII but digits and letters (upper-case letters are lowered before).
NOT_ALNUM = table_of(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
        a, b = int(starts[i]), int(ends[j - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[buf[a:b]] * _pow(_BASE, b - a), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * _pow(_INVERSE, b - a + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null counts as empty."""
    text = pc.fill_null(text, "") if text.null_count else text
    wide = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes in all."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(buf: np.ndarray, cuts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a document's bounds (``cuts``) also end words."""
    inside = ~separators[buf]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(buf))]
    start[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def prefix_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of every word."""
    return _hashes(buf, starts, np.minimum(starts + size, ends))


def documents(text: pa.Array, separators: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, hashes, bounds): the words of documents first..end-1; those
    of document first + i are hashes[bounds[i]:bounds[i + 1]]."""
    for i, j, buf, starts, ends, at in bounded(text, separators):
        yield i, j, _hashes(buf, starts, ends), at


def hash_of(word: str) -> int:
    """The hash that a word, already lower-case, has in any document."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_hashes(data, np.array([0]), np.array([len(data)]))[0])


def bounded(text: pa.Array, separators: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, bytes, starts, ends, bounds) of documents and their words."""
    off, data = raw(text)
    for i, j in chunks(off):
        buf = np.frombuffer(data[off[i] : off[j]].tobytes().lower(), np.uint8)
        cuts = off[i : j + 1] - off[i]
        starts, ends = word_bounds(buf, cuts, separators)
        yield i, j, buf, starts, ends, np.searchsorted(starts, cuts)
