"""Words and word shingles of Arrow string columns as numpy arrays, without a Python loop per word.

A word is a maximal run of bytes outside the six ASCII white-space bytes, so words are counted
alike by ``[^\\x20\\x09-\\x0D]+``. Word identity is a 64-bit polynomial hash of its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
CHUNK_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=2)
def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    if fold:
        values[65:91] = values[97:123]
    return values


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, kept for the process."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1000)
        out = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give unused memory back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_BYTES of text each; one row is never cut."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // CHUNK_BYTES
    edges = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
    release()


class Text:
    """A chunk of documents: bytes (each document followed by a newline) and where they start."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE):
        if pa.types.is_string(column.type):
            column = column.cast(pa.large_string())
        column = pc.fill_null(column, "")
        ended = pc.binary_join_element_wise(column, pa.scalar("", column.type), pa.scalar("\n", column.type))
        self.size = len(column)
        offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset:ended.offset + self.size + 1]
        data = ended.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if self.size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        space = separators[self.data]
        before = np.empty_like(space)
        before[:1] = True
        before[1:] = space[:-1]
        self.space = space
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(space & ~before)
        self.first = np.searchsorted(self.starts, self.offsets)  # of each document's words
        self.n_words = np.diff(self.first)

    def _totals(self, fold: bool) -> np.ndarray:
        n = len(self.data)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_byte_values(fold)[self.data] * powers(n + 1)[0][:n], out=total[1:])
        return total

    def _hashes(self, total: np.ndarray, ends: np.ndarray) -> np.ndarray:
        down = powers(len(self.data) + 1)[1]
        return mix((total[ends] - total[self.starts]) * down[self.starts] + (ends - self.starts).astype(np.uint64))

    def word_hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; fold: A-Z count as a-z."""
        return self._hashes(self._totals(fold), self.ends)

    def prefix_hashes(self, n: int, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's first n bytes."""
        return self._hashes(self._totals(fold), np.minimum(self.starts + n, self.ends))

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each document's 5-word windows, and where each document's begin (size + 1 entries)."""
        count = np.maximum(self.n_words - (SHINGLE - 1), 0)
        at = np.concatenate([[0], np.cumsum(count)])
        n = len(words)
        if n < SHINGLE:
            return np.zeros(0, np.uint64), at
        h = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0xF1357AEA2E62A9C5) + words[k:n - SHINGLE + 1 + k]
        keep = np.repeat(self.first[:-1] - at[:-1], count) + np.arange(at[-1])
        return mix(h[keep]), at


def shingle_sets(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin.

    Words are lower-cased (A-Z). A document of 1 to 4 words has its whole sequence as its one
    shingle; one without words has none.
    """
    words = text.word_hashes(fold=True)
    h, at = text.windows(words)
    short = np.flatnonzero((text.n_words > 0) & (text.n_words < SHINGLE))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            x = 0
            for w in words[text.first[d]:text.first[d + 1]]:
                x = (x * 0xF1357AEA2E62A9C5 + int(w) + 1) & 0xFFFFFFFFFFFFFFFF
            whole[i] = x ^ 0x5851F42D4C957F2D ^ int(text.n_words[d])
        h = np.insert(h, at[short], mix(whole))
        at = at + np.concatenate([[0], np.cumsum((text.n_words > 0) & (text.n_words < SHINGLE))])
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo > 1:
            h[lo:hi].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[at[:-1][at[:-1] < len(h)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return h[fresh], kept[at]
