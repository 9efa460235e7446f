"""Vectorised text helpers used inside Spark tasks.

A slice of rows is one UTF-8 byte buffer with row bounds; words, lines and n-grams
are index arrays over it and get 64-bit hashes without any Python string per word.
White space is ASCII 0x20 and 0x09-0x0D, so byte positions never cut a character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE_CODE = np.random.default_rng(20260601).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_RADIX = 0x9E3779B97F4A7C17  # odd, one less is twice an odd number
HASH_BYTES = 1 << 18   # stretch of text that is hashed at once
KEPT_POWERS = 1 << 20  # powers that stay between tasks; a longer text leaves none behind
_powers = np.ones(1, _U)
_inverse = np.ones(1, _U)


class Slice(NamedTuple):
    """Rows with their text as one byte buffer; row i is ``buf[start[i]:end[i]]``."""

    batch: pa.RecordBatch
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray


def release() -> None:
    """Give memory that was freed back to the system.

    Worker processes are reused; without this each keeps the peak of every task it ever ran, and
    those of one executor add up.
    """
    global _powers, _inverse
    if len(_powers) > KEPT_POWERS:
        _powers, _inverse = _powers[:1].copy(), _inverse[:1].copy()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut batches into slices of at most ``limit`` text bytes (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            base = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = column.slice(first, last - first)
            yield _slice(batch.slice(first, last - first), part)
            first = last
    release()


def _slice(batch: pa.RecordBatch, column: pa.Array) -> Slice:
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    return Slice(batch, raw, bounds[:-1], bounds[1:])


def from_texts(texts: list[str | None]) -> Slice:
    batch = pa.record_batch([pa.array(texts, pa.large_string())], ["text"])
    return _slice(batch, pc.fill_null(batch.column(0), ""))


def fold(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[buf]


def runs(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal True run; runs never cross a row."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = flag.copy()
    head[1:] &= ~flag[:-1]
    at = start[start < end]
    head[at] = flag[at]
    tail = flag.copy()
    tail[:-1] &= ~flag[1:]
    tail[end[start < end] - 1] = flag[end[start < end] - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def words(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of all words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~_SPACE[s.buf], s.start, s.end)


def row_of(s: Slice, position: np.ndarray) -> np.ndarray:
    return np.searchsorted(s.end, position, side="right")


def row_bounds(s: Slice, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted positions: which of them belong to each row, as index bounds."""
    return np.searchsorted(position, s.start), np.searchsorted(position, s.end)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every other."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        step, back = np.full(size, _RADIX, _U), np.full(size, pow(_RADIX, -1, 1 << 64), _U)
        step[0] = back[0] = 1
        _powers, _inverse = np.cumprod(step, dtype=_U), np.cumprod(back, dtype=_U)
    return _powers, _inverse


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the buffer; ``span_hash`` takes differences of it."""
    powers, _ = _tables(len(buf) + 1)
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum(_BYTE_CODE[buf] * powers[: len(buf)], dtype=_U, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes wherever they lie."""
    _, inverse = _tables(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _U(0x9FB21C651E98DF25))


def ordered_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, stretch: int = HASH_BYTES) -> np.ndarray:
    """``span_hash`` of spans that follow each other without overlap, a stretch of the buffer at a time.

    The numbers are the same; running sums and powers cover ``stretch`` bytes or one longer span.
    """
    out = np.empty(len(begin), _U)
    first = 0
    while first < len(begin):
        base = int(begin[first])
        last = max(first + 1, int(np.searchsorted(end, base + stretch, side="right")))
        sums = prefix_sums(buf[base: int(end[last - 1])])
        out[first:last] = span_hash(sums, begin[first:last] - base, end[first:last] - base)
        first = last
    return out


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbours (as many as fit)."""
    count = max(0, len(hashes) - n + 1)
    out = hashes[:count].copy()
    for k in range(1, n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[k: k + count])
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles of one text; a shorter text is one shingle, no word none."""
    if len(hashes) >= n:
        return np.unique(chain(hashes, n))
    return chain(hashes, len(hashes)) if len(hashes) else hashes[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
