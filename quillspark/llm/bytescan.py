"""Vectorised scanning of text columns as UTF-8 bytes.

A text column arrives as an Arrow array, that is as one byte buffer plus
offsets.  The functions here find words and hash them with whole-array numpy
operations, in slices of bounded size, so that no per-word Python object is
made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 3_000_000
_HASH_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = int(_rng.integers(2**40, 2**62)) | 1
_PINV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words separated by the six ASCII blanks.
NON_BLANK = np.ones(256, dtype=bool)
NON_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def fmix64(x: np.ndarray) -> np.ndarray:
    """The usual 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class TextSlice:
    """Consecutive rows of a batch: ``buf[offs[i]:offs[i + 1]]`` is row ``lo + i``."""

    buf: np.ndarray
    offs: np.ndarray
    lo: int

    def __len__(self) -> int:
        return len(self.offs) - 1

    def row(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if big else np.int32
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """The column in runs of rows of about ``limit`` bytes; a longer row stands alone."""
    buf, offs = text_buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield TextSlice(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo)
        lo = hi


@dataclass
class Words:
    """Word bounds in a slice; words of row ``i`` are ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(s: TextSlice, table: np.ndarray = NON_BLANK) -> Words:
    """Maximal runs of bytes that ``table`` admits, never across rows."""
    n = len(s.buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(s.offs), np.int64))
    mask = table[s.buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    cuts = s.offs[:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    cuts = s.offs[1:-1]
    after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    return Words(start, end, np.searchsorted(start, s.offs))


_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * _HASH_BYTES)
        tables = [np.full(n, p, np.uint64) for p in (_P, _PINV)]
        for t in tables:
            t[0] = 1
        _powers[:] = [np.cumprod(t, dtype=np.uint64) for t in tables]
    return _powers[0], _powers[1]


def word_hashes(buf: np.ndarray, w: Words, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if ``lower``).

    A polynomial over random byte values, modulo 2**64, taken as a difference
    of prefix sums and then mixed with the length.
    """
    out = np.empty(len(w.start), np.uint64)
    table = _BYTE[LOWER] if lower else _BYTE
    i = 0
    while i < len(w.start):
        base = int(w.start[i])
        j = max(i + 1, int(np.searchsorted(w.end, base + _HASH_BYTES, side="right")))
        stop = int(w.end[j - 1])
        power, inverse = _tables(stop - base + 1)
        sums = np.empty(stop - base + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[buf[base:stop]] * power[: stop - base], out=sums[1:])
        a, b = w.start[i:j] - base, w.end[i:j] - base
        out[i:j] = fmix64((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


_COMBINE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words, over all of a slice.

    Entry ``i`` stands for words ``i .. i + k - 1``; the caller drops the runs
    that cross rows (``gram_valid``).
    """
    n = max(0, len(h) - k + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = (acc + h[j : j + n]) * _COMBINE
        acc ^= acc >> np.uint64(29)
    return fmix64(acc)


def gram_rows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the range of its runs of ``k`` words as indexes of ``gram_hashes``."""
    lo = w.first[:-1]
    return lo, np.maximum(lo, w.first[1:] - k + 1)


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole short word sequence, apart from those of full shingles."""
    acc = 0x51ED270B
    for x in h.tolist():
        acc = ((acc ^ x) * 0x9E3779B97F4A7C15 + len(h)) & 0xFFFFFFFFFFFFFFFF
        acc ^= acc >> 31
    return acc
