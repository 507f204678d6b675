"""Byte measures of one payload, in numpy. Arrow kernels and tests use them; sql.py has the measures that SQL can say."""

from __future__ import annotations

import math

import numpy as np

#: Bytes that the measures look at, and the shortest payload that has one.
ENTROPY_CAP, REPEAT_CAP, BIGRAM_CAP, WINDOW_CAP = 1 << 18, 1 << 18, 1 << 17, 1 << 12
ENTROPY_FLOOR, REPEAT_FLOOR, BIGRAM_FLOOR = 16, 2, 4


def raw(data: bytes | memoryview | np.ndarray) -> np.ndarray:
    return data if isinstance(data, np.ndarray) else np.frombuffer(data, np.uint8)


def shannon(counts: np.ndarray) -> float:
    """Bits a symbol. Terms are added one after another, by symbol, so that equal counts give equal floats."""
    p = counts[counts > 0] / counts.sum()
    return -float(np.cumsum(p * np.log(p))[-1]) / math.log(2) if len(p) else 0.0


def byte_entropy_bits(data) -> float:
    b = raw(data)[:ENTROPY_CAP]
    return shannon(np.bincount(b, minlength=256)) if len(b) >= ENTROPY_FLOOR else 0.0


def repeat_density(data) -> float:
    """Share of bytes that equal the byte before."""
    b = raw(data)[:REPEAT_CAP]
    return float(np.count_nonzero(b[1:] == b[:-1])) / (len(b) - 1) if len(b) >= REPEAT_FLOOR else 0.0


def bigram_repeat_proxy(data) -> float:
    """Share of byte pairs that equal the pair before."""
    b = raw(data)[:BIGRAM_CAP]
    return float(np.count_nonzero((b[3:] == b[1:-2]) & (b[2:-1] == b[:-3]))) / (len(b) - 3) if len(b) >= BIGRAM_FLOOR else 0.0


def match_strength(entropy: float, repeat: float, bigram: float) -> float:
    return max(0.0, repeat * 2.4 + bigram * 1.6 + (8.0 - min(max(entropy, 0.0), 8.0)) * 0.35)


def signals(data) -> tuple[float, float, float]:
    return byte_entropy_bits(data), repeat_density(data), bigram_repeat_proxy(data)


def class_counts(data) -> tuple[int, int, int]:
    """Zero bytes, visible ASCII with tab and line ends, and all others (the space is one of these)."""
    n = np.bincount(raw(data), minlength=256)
    text = int(n[0x21:0x7F].sum() + n[[0x09, 0x0A, 0x0D]].sum())
    return int(n[0]), text, int(n.sum()) - int(n[0]) - text


def window_entropy(data: np.ndarray, first: int, last: int) -> float:
    """Entropy of first..last-1, of its first WINDOW_CAP bytes; 0 up to 16 bytes."""
    return shannon(np.bincount(data[first : min(last, first + WINDOW_CAP)], minlength=256)) if last > first + ENTROPY_FLOOR else 0.0


def bucket(data: np.ndarray) -> np.ndarray:
    """Bucket of each 3-byte string. Multiplying by an odd number permutes the low 15 bits, so buckets are those of (second byte & 127, third byte)."""
    return ((data[1:-1].astype(np.int64) & 127) << 8) | data[2:] if len(data) >= 3 else np.zeros(0, np.int64)


def bucket_hash(b0: int, b1: int, b2: int) -> int:
    """The 15-bit hash itself."""
    return ((b0 << 16 | b1 << 8 | b2) * 0x9E3779B9) & 0x7FFF


def position_hash(byte: int, position: int) -> int:
    """64-bit hash of a byte at a position."""
    mask = (1 << 64) - 1
    x = (position * 0x9E3779B185EBCA87 & mask) ^ (byte * 0xC2B2AE3D27D4EB4F & mask)
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & mask
    return x ^ x >> 33


def half_up(x: float) -> int:
    """Rounds halves away from zero (x is not negative)."""
    return math.floor(x + 0.5)
