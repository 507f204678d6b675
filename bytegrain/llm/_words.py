"""Words of Arrow string columns as numpy arrays.

A word is a maximal run of word bytes inside one text. All byte classes used
here are ASCII, so a UTF-8 text can be cut byte by byte. Each word gets a
64-bit hash; a run of words gets a hash in constant time from prefix sums
(polynomials modulo 2**64 with odd bases, so powers can be inverted, each
followed by an avalanche step).
"""

from __future__ import annotations

import ctypes
import functools
import platform
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche step on 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _powers(base: int, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < 2**log2, modulo 2**64."""
    def series(b: int) -> np.ndarray:
        out = np.full(1 << log2, b, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return series(base), series(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(16, int(max(n, 1) - 1).bit_length()))


@functools.cache
def _class(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: is it part of a word, and its value in a word's hash."""
    value = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) | U(1)
    if kind == "space":
        word = np.ones(256, bool)
        word[list(SPACES)] = False
        return word, value
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x61:0x7B] = word[0x41:0x5B] = word[0x80:] = True
    return word, value


@functools.cache
def _fold(kind: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    word, value = _class(kind)
    if lower:
        value = value.copy()
        value[0x41:0x5B] = value[0x61:0x7B]
    return word, value


def texts(column: pa.Array | pa.ChunkedArray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string column of about most_bytes: first row, bytes, and offsets (one more than rows). Null is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        if not len(chunk):
            continue
        _, offsets, data = chunk.buffers()
        off = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
            yield row + at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
        row += len(chunk)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives freed memory back to the system at its end: Python workers stay on and wait for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and platform.libc_ver()[0] == "glibc":
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


class Words:
    """The words of one piece: start and end bytes, document, hash, and each document's first word (words_at)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str, lower: bool):
        word, value = _fold(kind, lower)
        self.data, self.offsets = data, offsets
        inside = word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        here = np.zeros(len(data) + 1, bool)
        here[:-1] = inside
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.words_at = np.searchsorted(self.start, offsets)
        self.words_at[-1] = len(self.start)
        self.n_words = np.diff(self.words_at)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.n_words)
        up, down = powers(_BYTE_BASE, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(np.where(inside, value[data], U(0)) * up[: len(data)], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def sums(self, seed: int = 0) -> np.ndarray:
        """Prefix sums from which runs() takes hashes; another seed gives independent hashes."""
        up, _ = powers(_WORD_BASE, len(self))
        h = mixed(self.hash ^ U(seed)) if seed else self.hash
        out = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(h * up[: len(self)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words first..last-1 (arrays)."""
        _, down = powers(_WORD_BASE, len(self))
        return mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """First words of all runs of n words inside one document."""
        if len(self) < n:
            return np.zeros(0, np.int64)
        first = np.arange(len(self) - n + 1)
        return first[self.doc[: len(first)] == self.doc[n - 1 :]]

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n words lie in any of the runs first..last-1."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    return np.cumsum(steps[:-1]) > 0
