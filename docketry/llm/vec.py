"""Whole-batch text kernels in numpy: words, word windows, XXH64, per-document sums.

Words are the runs of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only. All functions work on a
flat byte buffer with offsets, so a batch of documents costs a fixed number of array passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# XXH64's published primes
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int):
    """Row ranges of about ``limit`` bytes each, at least one row long."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        yield at, max(to, at + 1)
        at = max(to, at + 1)


class Words:
    """Words of a batch: ``buf`` holds them joined by one space, ``start``/``end`` bound each, ``rows`` has row offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        inside = ~_SPACE[low]
        n = len(low)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < n)]
            first[edges] = inside[edges]
            last[edges - 1] = inside[edges - 1]
        keep = inside.copy()
        if n:
            keep[1:] |= inside[:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(start, offsets)
        if not keep.all():
            at = np.cumsum(keep)
            start, end = at[start] - 1, at[end - 1]
            low = low[keep]
            low[_SPACE[low]] = 0x20
        else:
            low[~inside] = 0x20
        self.start, self.end = start, end
        self.buf = np.concatenate([low, np.zeros(8, np.uint8)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and row offsets of all ``size``-word windows; a shorter row is one window, an empty one none."""
        count = np.diff(self.rows)
        made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        rows = np.concatenate([[0], np.cumsum(made)])
        head = np.arange(rows[-1]) + np.repeat(self.rows[:-1] - rows[:-1], made)
        tail = head + np.repeat(np.minimum(count, size), made) - 1
        return self.start[head], self.end[tail] - self.start[head], rows


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of each window ``buf[start:start+size]``; ``buf`` has eight bytes of padding."""
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(buf, (max(len(buf) - 7, 0), 8), (1, 1))).view("<u8").ravel()
        at, size = start.astype(np.int64), size.astype(np.int64)
        h = np.full(len(at), seed + _P5, dtype=np.uint64)
        wide = np.flatnonzero(size >= 32)
        if len(wide):
            wide = wide[np.argsort(-(size[wide] >> 5), kind="stable")]
            stripes, p = size[wide] >> 5, at[wide]
            acc = [np.full(len(wide), s, dtype=np.uint64) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            for k in range(int(stripes[0])):
                live = int(np.searchsorted(-stripes, -k, side="left"))
                for lane in range(4):
                    acc[lane][:live] = _round(acc[lane][:live], eight[p[:live] + 32 * k + 8 * lane])
            out = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            zero = np.zeros(1, np.uint64)
            for a in acc:
                out = (out ^ _round(zero, a)) * _P1 + _P4
            h[wide] = out
            at = at.copy()
            at[wide] += 32 * stripes
        h += size.astype(np.uint64)
        left = size & 31
        for k in range(3):
            live = np.flatnonzero(left >= 8 * (k + 1))
            if not len(live):
                break
            x = h[live] ^ _round(np.zeros(1, np.uint64), eight[at[live] + 8 * k])
            h[live] = _turn(x, 27) * _P1 + _P4
        at = at + (left & 24)
        live = np.flatnonzero(left & 4)
        x = h[live] ^ ((eight[at[live]] & np.uint64(0xFFFFFFFF)) * _P1)
        h[live] = _turn(x, 23) * _P2 + _P3
        at = at + (left & 4)
        for k in range(3):
            live = np.flatnonzero((left & 3) > k)
            x = h[live] ^ (buf[at[live] + k].astype(np.uint64) * _P5)
            h[live] = _turn(x, 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(32))) * _P1 + _turn(b, 23) * _P2
        x ^= x >> np.uint64(29)
        x *= _P3
        return x ^ (x >> np.uint64(32))


def row_sums(values: np.ndarray, rows: np.ndarray, kind: type | None = None) -> np.ndarray:
    """Sum of ``values``, as ``kind``, in each row range; empty ranges give zero. Works along axis 0."""
    out = np.zeros((len(rows) - 1, *values.shape[1:]), dtype=kind or values.dtype)
    full = np.flatnonzero(np.diff(rows))
    if len(full):
        out[full] = np.add.reduceat(values, rows[:-1][full], axis=0, dtype=kind)
    return out


def bit_counts(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many hashes of each row have each of the 64 bits: an (rows, 64) table, bit 0 first."""
    count = np.diff(rows)
    parts = (count + 254) // 255
    first = np.concatenate([[0], np.cumsum(parts)])
    cuts = np.repeat(rows[:-1], parts) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], parts))
    cuts = np.append(cuts, rows[-1])
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    table = np.empty((len(cuts) - 1, 64), dtype=np.int64)
    for k in range(8):  # eight one-byte counters in a word; a part has at most 255 hashes
        lanes = row_sums(_SPREAD[octets[:, k]], cuts)
        table[:, 8 * k : 8 * k + 8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return row_sums(table, first)


def majority(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """SimHash of each row: a bit is one if more than half of the row's hashes have it."""
    on = 2 * bit_counts(hashes, rows) > np.diff(rows)[:, None]
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel() if len(on) else np.zeros(0, np.uint64)
