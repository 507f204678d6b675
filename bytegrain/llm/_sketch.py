"""A count-min sketch of 64-bit keys that tells which keys may occur twice.

Each input partition counts its keys in `ROWS` rows of 2**log2 cells; a counter
saturates at two, so it is two bits: "once" and "twice". Partition sketches are cut
into chunks, compressed, dealt out by chunk and merged as a stream, so no task ever
holds more than its chunks. What comes back is the "twice" bits: at most
ROWS * 2**log2 / 8 bytes, whatever the size of the input. A key that occurs at
least twice always has all its bits set; another key may have them too, so the
sketch overestimates and loses nothing. At x keys a cell a unique key passes with
chance (1 - exp(-x))**2: 1.4 % at an eighth, 15 % at a half, where log2_for() ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bytegrain.llm._words import freed

ROWS = 2
CHUNK = 1 << 16  # bytes of a chunk
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: 2 rows of 2**28 bits: 64 MB at most are broadcast.
MOST_LOG2 = 28


def log2_for(keys: int) -> int | None:
    """Cells for about so many keys: eight a key, from 2**19 to 2**MOST_LOG2.

    None where even the largest sketch would have more than half a key a cell and so
    let over 15 % of the unique keys pass: callers then deal all keys out by hash and
    count each in the partition that owns it.
    """
    if 2 * keys > 1 << MOST_LOG2:
        return None
    return min(MOST_LOG2, max(19, (8 * max(1, keys) - 1).bit_length()))


def _cells(keys: np.ndarray, row: int, log2: int) -> np.ndarray:
    return ((keys * np.uint64(_MULTIPLIERS[row])) >> np.uint64(64 - log2)).astype(np.uint32)


class Sketch:
    def __init__(self, log2: int):
        self.log2 = log2
        self.once = [np.zeros(1 << log2 - 3, np.uint8) for _ in range(ROWS)]
        self.twice = [np.zeros(1 << log2 - 3, np.uint8) for _ in range(ROWS)]

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        for row in range(ROWS):
            cells = np.sort(_cells(keys, row, self.log2))
            new = np.concatenate(([True], cells[1:] != cells[:-1]))
            for some, again in ((cells[~new], True), (cells[new], False)):
                if not len(some):
                    continue
                byte = some >> np.uint32(3)
                bit = np.left_shift(np.uint8(1), (some & np.uint32(7)).astype(np.uint8))
                at = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
                byte, bits = byte[at], np.bitwise_or.reduceat(bit, at)
                if again:
                    self.twice[row][byte] |= bits
                else:
                    self.twice[row][byte] |= self.once[row][byte] & bits
                    self.once[row][byte] |= bits

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for row in range(ROWS):
            for at in range(0, len(self.once[row]), CHUNK):
                once = self.once[row][at : at + CHUNK]
                if once.any():
                    twice = self.twice[row][at : at + CHUNK]
                    yield row << 32 | at // CHUNK, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


class Twice:
    """The merged "twice" bits: which keys may occur at least twice."""

    def __init__(self, log2: int, rows: list[np.ndarray]):
        self.log2, self.rows = log2, rows

    def __getstate__(self) -> tuple[int, list[bytes]]:
        return self.log2, [zlib.compress(x.tobytes(), 1) for x in self.rows]

    def __setstate__(self, state: tuple[int, list[bytes]]) -> None:
        self.log2, rows = state
        self.rows = [np.frombuffer(zlib.decompress(x), np.uint8) for x in rows]

    def may(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row, bits in enumerate(self.rows):
            cells = _cells(keys, row, self.log2)
            out &= (bits[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & np.uint8(1) != 0
        return out


_SCHEMA = "chunk long, once binary, twice binary"


def may_repeat(source: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2: int) -> Twice:
    """The merged sketch of all keys that keys_of() finds in source's batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = None
        for batch in batches:
            for keys in keys_of(batch):
                sketch = sketch or Sketch(log2)
                sketch.add(keys)
        for chunk, once, twice in sketch.chunks() if sketch else ():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([once]), pa.array([twice])], names=["chunk", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
                if chunk in held:
                    first, second = held[chunk]
                    second |= twice
                    second |= first & once
                    first |= once
                else:
                    held[chunk] = once.copy(), twice.copy()
        for chunk, (_, twice) in held.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([None], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)])], names=["chunk", "once", "twice"])

    # collect() below: bounded by ROWS * 2**log2 / 8 bytes
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = source.mapInArrow(freed(count), _SCHEMA).repartition(parts, "chunk").mapInArrow(freed(merge), _SCHEMA).select("chunk", "twice")
    rows = [np.zeros(1 << log2 - 3, np.uint8) for _ in range(ROWS)]
    for chunk, twice in merged.collect():
        at = (chunk & 0xFFFFFFFF) * CHUNK
        got = np.frombuffer(zlib.decompress(bytes(twice)), np.uint8)
        rows[chunk >> 32][at : at + len(got)] = got
    return Twice(log2, rows)


def members(source: DataFrame, column: str, log2: int) -> Twice:
    """The bits of all of a column's values: each is counted twice."""

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield np.concatenate((keys, keys))

    return may_repeat(source.select(column), keys_of, log2)
