"""Vectorised word kernels over Arrow string buffers.

Helpers that run inside ``mapInArrow`` tasks: rows arrive as Arrow batches and
are cut into slices of a quarter of a megabyte (a longer row is one slice, cut again
at word boundaries), so a task's memory does not follow the length of a text.
Words are 64-bit hashes of their bytes; no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)  # odd, so that its powers can be inverted modulo 2**64
_INV = U64(pow(int(_BASE), -1, 1 << 64))


def byte_classes(separators) -> np.ndarray:
    """256 entries: 0 for a separator byte, else 1 + the byte with A-Z lower-cased."""
    lut = np.arange(1, 257, dtype=np.uint16)
    lut[65:91] += 32
    lut[list(separators)] = 0
    return lut


#: ``[^\x20\x09-\x0D]+``
WORDS_BLANK = byte_classes([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z were lower-cased
WORDS_ALNUM = byte_classes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of an Arrow string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class _Powers:
    """Powers of the base and of its inverse, grown on demand; never sent along with a task function."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def __reduce__(self):
        return (_Powers, ())

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, SLICE_BYTES + 1)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, b, U64)])) for b in (_BASE, _INV))


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _hash(cls: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word; no word crosses a row start."""
    n = len(cls)
    _powers.grow(n)
    word = cls != 0
    gap = np.ones(n + 1, bool)
    np.logical_not(word, out=gap[1:])
    before = gap[:-1].copy()
    before[row_starts[row_starts < n]] = True
    starts = np.flatnonzero(word & before)
    after = np.ones(n, bool)
    np.logical_not(word[1:], out=after[:-1])
    inner = row_starts[(row_starts > 0) & (row_starts <= n)]
    after[inner - 1] = True
    ends = np.flatnonzero(word & after) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum(cls.astype(U64) * _powers.up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers.down[starts] + (ends - starts).astype(U64)), starts


def words(buf: np.ndarray, off: np.ndarray, lo: int, hi: int, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words per row) of rows lo..hi."""
    a, b = int(off[lo]), int(off[hi])
    cls = lut[buf[a:b]]
    if len(cls) <= 2 * SLICE_BYTES or hi - lo > 1:
        h, starts = _hash(cls, (off[lo:hi] - a))
        row = np.searchsorted(off[lo + 1:hi] - a, starts, side="right")
        return h, np.bincount(row, minlength=hi - lo)
    parts, at = [], 0
    while at < len(cls):  # one long row, cut after a separator
        end = min(len(cls), at + SLICE_BYTES)
        if end < len(cls):
            cut = np.flatnonzero(cls[at:end] == 0)
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                nxt = np.flatnonzero(cls[end:] == 0)
                end = end + int(nxt[0]) + 1 if len(nxt) else len(cls)
        parts.append(_hash(cls[at:end], np.zeros(1, np.int64))[0])
        at = end
    h = np.concatenate(parts)
    return h, np.array([len(h)])


def word_rows(column, lut: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words per row) for each slice of a column."""
    buf, off = utf8(column)
    for lo, hi in slices(off):
        h, n = words(buf, off, lo, hi, lut)
        yield lo, h, n


def shingle_sets(h: np.ndarray, counts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct k-word shingles; a row of fewer words has its whole sequence as one."""
    coef = [mix(np.array([i + 1], U64))[0] | U64(1) for i in range(k)]
    n = len(h) - k + 1
    sh = np.zeros(max(n, 0), U64)
    for i in range(k):
        if n > 0:
            sh += mix(h[i:i + n] + U64(i)) * coef[i]
    sh = mix(sh)
    at = 0
    for c in counts:
        c = int(c)
        if c >= k:
            yield np.unique(sh[at:at + c - k + 1])
        elif c:
            acc = U64(c)
            for i in range(c):
                acc = mix(np.array([acc], U64) * U64(0x9E3779B97F4A7C15) + h[at + i:at + i + 1])[0]
            yield np.array([acc], U64)
        else:
            yield np.zeros(0, U64)
        at += c
