"""Words of many texts at once: NumPy over the UTF-8 bytes of an Arrow string column.

A word class is a table of 256 flags. Both classes in use only part at ASCII bytes, so
bytes of multi-byte characters never split. A word's fingerprint is a polynomial over
random byte values modulo 2**64 (taken from a running sum) with a mixing step behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
PART_BYTES = 4 << 20

_rng = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 1)
        step = np.full(size, _MUL, np.uint64)
        step[0] = 1
        _pow = np.cumprod(step, dtype=np.uint64)
        step[1:] = _INV
        _ipow = np.cumprod(step, dtype=np.uint64)
    return _pow[:n], _ipow[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Some consecutive texts: bytes (A-Z lowered if asked), and their words."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray, cls: np.ndarray, lower: bool = True):
        self.first = first  # index of the first text in the batch
        self.bounds = bounds  # byte offsets, one more than texts
        self.n = len(bounds) - 1
        data = _LOWER[data] if lower else data
        self.data = data
        flag = cls[data]
        before = np.empty_like(flag)
        before[:1] = False
        before[1:] = flag[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        after = np.empty_like(flag)
        after[-1:] = False
        after[:-1] = flag[1:]
        ends = bounds[1:]
        after[ends[ends > 0] - 1] = False
        self.start = np.flatnonzero(flag & ~before)
        self.end = np.flatnonzero(flag & ~after) + 1
        #: index of each text's first word, one more than texts
        self.word_at = np.searchsorted(self.start, bounds)

    def hashes(self) -> np.ndarray:
        """Fingerprints of the words. A long text is worked through in parts, so that its size costs little memory."""
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PART_BYTES, "right")))
            first, last = self.start[i], self.end[j - 1]
            pw, ipw = _powers(int(last - first) + 1)
            run = np.empty(last - first + 1, np.uint64)
            run[0] = 0
            np.cumsum(_BYTE[self.data[first:last]] * pw[:-1], dtype=np.uint64, out=run[1:])
            at = self.start[i:j] - first
            out[i:j] = mix((run[self.end[i:j] - first] - run[at]) * ipw[at])
            i = j
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts())


def slices(column: pa.Array, cls: np.ndarray, lower: bool = True, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of about ``limit`` bytes (one text at least) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], cls, lower)
        i = j


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every run of ``width`` words (runs may cross texts: callers drop those)."""
    out = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(out)]
        out = mix(out)
    return out
