"""Words of Arrow string columns and 64-bit hashes of them, as whole-array numpy operations.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]; those bytes never occur inside a UTF-8 character, so words are
found in the bytes. Batches are worked through in slices of bounded size, so memory follows the longest text and not
the batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Longer words are hashed one by one.
_LONG = 2048
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def released(run: Callable) -> Callable:
    """``run``, a map over batches, that gives freed memory back to the system at its end: a Python worker lives on, and
    with it what its allocators keep of earlier stages."""

    def mapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return mapped


class Words:
    """The words of some texts: ``data`` (bytes), ``start``, ``end`` (in data), ``doc`` (index of the text), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        space = _SPACE[data]
        inside = ~space
        before = np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            edges = offsets[:-1][offsets[:-1] < len(data)]
            before[edges] = False
            self.start = np.flatnonzero(inside & ~before)
            after = np.empty_like(inside)
            after[-1], after[:-1] = False, inside[1:]
            ends = offsets[1:][offsets[1:] > 0] - 1
            after[ends] = False
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        #: Words of text i: first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, offsets)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self._hashed()
        return self._hash

    def _hashed(self) -> np.ndarray:
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(max(len(self.data), 1), "<u8", padded, strides=(1,))
        length = self.end - self.start
        h = mix(length.astype(np.uint64) + _C1)
        todo, k = np.flatnonzero(length <= _LONG), 0
        while len(todo):
            rest = length[todo] - 8 * k
            v = eight[self.start[todo] + 8 * k] & _KEEP[np.minimum(rest, 8)]
            h[todo] = mix(h[todo] * _C1 + v)
            todo, k = todo[rest > 8], k + 1
        for i in np.flatnonzero(length > _LONG):
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return h


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) over consecutive rows of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, Words(data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64))
        i = j


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each ``length`` consecutive values (n - length + 1 of them), in log(length) array steps."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    left = length
    while left:
        if left & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out * _C1 + part)
            done += size
        left >>= 1
        if left:
            m = len(power) - size
            power, size = mix(power[:m] * _C3 + power[size : size + m]), size * 2
    return out


def windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every ``length`` consecutive words of one text."""
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[: len(words) - length + 1] == words.doc[length - 1 :])
    return at, runs(words.hash, length)[at]
