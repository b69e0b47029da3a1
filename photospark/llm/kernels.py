"""Vector kernels over the bytes of whole texts, used inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts with about CHUNK bytes; a longer text is a run of its own."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words (runs without space, tab or line breaks) of the texts of a chunk.

    ``start``/``end`` are byte positions, ``hash`` a 64-bit hash of the word, and the words of text ``i`` are
    ``first[i]:first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        live = ~SEPARATOR[data] if len(data) else np.zeros(0, bool)
        left = np.zeros(len(data), bool)
        left[1:] = live[:-1]
        left[offsets[:-1][offsets[:-1] < len(data)]] = False
        right = np.zeros(len(data), bool)
        right[:-1] = live[1:]
        right[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(live & ~left)
        self.end = np.flatnonzero(live & ~right) + 1
        self.first = np.searchsorted(self.start, offsets)
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))


def windows(words: Words, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; only positions that stay inside a text are meaningful."""
    h = words.hash
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += h[j:j + n] * _PLACE[j]
    return mix(out)


def shingles(words: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text; a shorter text is one shingle, an empty one none."""
    runs = windows(words, size)
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(runs[lo:hi - size + 1]))
        elif hi > lo:
            whole = (words.hash[lo:hi] * _PLACE[:hi - lo]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + np.array([hi - lo], np.uint64) * _PLACE[63]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
