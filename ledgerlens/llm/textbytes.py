"""Texts of an Arrow column as one UTF-8 byte array: tokens, hashes and rolling windows without a Python loop per word.

Positions are byte positions in the joined buffer.  A null text is an empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WORD = np.zeros(256, dtype=bool)  # digits, a-z and every byte of a non-ASCII character
WORD[48:58] = WORD[97:123] = WORD[128:] = True

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Parts of a batch with about ``limit`` bytes of text each, one row at least: memory follows the longest text, not the batch."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, off = raw(col)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (with the end as the last entry)."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def tokens(buf: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes within each text: starts, ends, and for each text the index of its first run (with the end)."""
    n = buf.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(off.size, np.int64)
    inside = keep[buf]
    begins = np.zeros(n + 1, dtype=bool)
    begins[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[begins[:n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[begins[1:]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, read eight bytes at a time."""
    size = end - start
    h = (size.astype(np.uint64) + np.uint64(seed)) * _M1
    if not start.size:
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((buf.size + 1,), dtype="<u8", buffer=padded, strides=(1,))
    act, at, left, j = None, start, size, 0
    while True:
        more = np.flatnonzero(left > 0)
        if not more.size:
            return mix(h)
        if more.size < left.size or act is None:
            act = more if act is None else act[more]
            at, left = at[more], left[more]
        v = eight[at] & _MASK[np.minimum(left, 8)]
        g = (h[act] ^ v) * _M2
        h[act] = g ^ (g >> np.uint64(29))
        at, left, j = at + 8, left - 8, j + 1


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive token hashes (ignoring text borders; the caller masks those)."""
    n = h.size - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(size):
        acc = acc * _M1 + h[i : i + n]
    return mix(acc + np.uint64(size))


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` tokens begin and end in one text."""
    n = int(first[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    ok = np.ones(n, dtype=bool)
    for e in range(1, size):  # a run may not begin within the last size-1 tokens of a text
        at = first[1:] - e
        at = at[(at >= first[:-1]) & (at < n)]
        ok[at] = False
    return ok
