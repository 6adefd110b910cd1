"""Vectorised work on the UTF-8 bytes of Arrow text columns (numpy).

A chunk is a run of rows of one Arrow batch whose texts together are about
``CHUNK_BYTES`` long (one longer text is a chunk of its own), so the working
memory of every caller is bounded by the chunk and not by the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator: a bijection on 64 bits."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64))
_ODD = int(splitmix(np.array([77], dtype=np.uint64))[0]) | 1
_INV = pow(_ODD, -1, 1 << 64)
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)

#: Space and U+0009..U+000D part words.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, CHUNK_BYTES + 1)
        _pow = np.full(n, _ODD, dtype=np.uint64)
        _inv = np.full(n, _INV, dtype=np.uint64)
        _pow[0] = _inv[0] = 1
        np.cumprod(_pow, out=_pow)
        np.cumprod(_inv, out=_inv)
    return _pow, _inv


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """Yield (first row, row after the last, bytes, offsets) of each chunk."""
    data, offs = text_buffers(column)
    n, i = len(column), 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SEPARATOR[data]
    start, last = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[:-1][offs[:-1] < len(data)]
    start[cut] = inside[cut]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes anywhere."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return splitmix((total[ends] - total[starts]) * inverse[starts])


def rolling_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte windows (k from 9 to 24), from 8-byte loads."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.empty(len(data), np.uint64)
    for r in range(8):
        part = padded[r : r + (len(data) - r + 7) // 8 * 8]
        part = part[: len(part) // 8 * 8].view("<u8")
        loads[r::8] = part[: len(loads[r::8])]
    h = loads[:n] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    if k > 16:
        h += loads[8 : 8 + n]
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
    h += loads[k - 8 : k - 8 + n]
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start+1, ... of the given counts."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=at[1:])
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, counts)
