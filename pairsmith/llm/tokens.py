"""Vectorised words, hashes and shingles over the byte buffers of Arrow string arrays."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: ASCII white space and A-Z in lower case, by byte.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64; kept only for slices of usual size."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    both = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 4 * SLICE_BYTES:
        _powers[:] = both
    return both[0][:n], both[1][:n]


def release() -> None:
    """Give freed memory back to the system, where the C library can: a worker process outlives its task."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slim(run):
    """A partition function that gives its memory back at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def slices(texts: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, lower-cased bytes, row offsets) for slices of about ``most`` bytes and ``rows`` rows; null is empty.

    A row longer than ``most`` makes a slice of its own: whole texts only.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield at, to, LOWER[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of other bytes than white space; no run crosses a row's border."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~IS_SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = True
    last[borders - 1] = True
    starts, ends = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over scrambled bytes, modulo 2 ** 64, scrambled again."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * power[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words; the words of a row with fewer make one shingle together."""
    counts = np.bincount(rows, minlength=n_rows)
    keep, out = len(hashes) - width + 1, np.zeros(0, np.uint64)
    own = np.zeros(0, np.int64)
    if keep > 0:
        total = np.zeros(keep, np.uint64)
        for k in range(width):
            total = total * np.uint64(0x100000001B3) + mix64(hashes[k : k + keep] + np.uint64(k))
        whole = rows[:keep] == rows[width - 1 :]
        out, own = mix64(total)[whole], rows[:keep][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        ends = np.cumsum(counts)
        extra = []
        for r in short:
            total = np.uint64(counts[r])
            for h in hashes[ends[r] - counts[r] : ends[r]]:
                total = np.uint64((int(total) * 0x100000001B3 + int(h)) & 0xFFFFFFFFFFFFFFFF)
            extra.append(total)
        own, out = np.concatenate([own, short]), np.concatenate([out, mix64(np.array(extra, np.uint64))])
    return own, out


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs with their counts, ordered by row, then by hash."""
    if not len(rows):
        return rows, hashes, np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, hashes = rows[order], hashes[order]
    new = np.empty(len(rows), bool)
    new[0] = True
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))
