"""Vectorised text kernels shared by the operators of this subpackage.

They work on the byte buffers of Arrow string columns, a few megabytes at a time, so memory does not grow with a batch.
A word is a run of bytes other than space and 0x09-0x0D, which in UTF-8 equals the pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_500_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, offsets, bytes) for runs of rows of at most ``limit`` bytes, one row at least. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def word_spans(offsets: np.ndarray, data: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words, which are runs of bytes that ``gaps`` (256 flags) does not name; a word never crosses a row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gaps[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * SLICE_BYTES)
        inverse = pow(_BASE, -1, 2**64)
        both = []
        for base in (_BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > 4 * SLICE_BYTES:
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of one prefix sum of randomised bytes."""
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and their rows. A row of 1 to k-1 words has one shingle, its whole sequence."""
    count = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    out, of = [], []
    if len(words) >= k:
        full = rows[k - 1 :] == rows[: len(rows) - k + 1]
        h = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            h = mix64(h + words[i : len(words) - k + 1 + i] + np.uint64(i + 1))
        out.append(h[full])
        of.append(rows[: len(rows) - k + 1][full])
    first = np.concatenate(([0], np.cumsum(count)))
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            h = np.full(len(short), n, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for i in range(n):
                h = mix64(h + words[first[short] + i] + np.uint64(i + 1))
            out.append(h)
            of.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out), np.concatenate(of)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def distinct_sorted(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order, end to end, and the offsets of the rows. ``rows`` ascends."""
    hashes = hashes.copy()
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    if len(hashes) > 1:
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return hashes[fresh], kept[bounds]
