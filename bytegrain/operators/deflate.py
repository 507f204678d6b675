"""DEFLATE blocks from tokens: length-limited prefix codes, block headers and bit streams."""

from __future__ import annotations

import functools
import itertools
import zlib
from dataclasses import dataclass

import numpy as np

from bytegrain.errors import CompressionFailed
from bytegrain.operators.lz import Tokens

END, LITERALS, DISTANCES = 256, 286, 30
MOST_TOKENS = 1 << 28

# Fixed values of the format: order of code-length codes.
LENGTH_CODE_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]


@functools.cache
def length_symbols() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each match length its symbol, extra bits and extra value. Groups of four symbols share a number of extra bits; 258 has a symbol of its own."""
    symbol, bits, extra = (np.zeros(259, np.int64) for _ in range(3))
    at = 3
    for s in range(257, 285):
        n = max(0, (s - 261) // 4)
        for k in range(1 << n):
            symbol[at + k], bits[at + k], extra[at + k] = s, n, k
        at += 1 << n
        if at > 258:
            break
    symbol[258], bits[258], extra[258] = 285, 0, 0
    return symbol, bits, extra


@functools.cache
def distance_symbols() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distance its symbol, extra bits and extra value. Pairs of symbols share a number of extra bits."""
    symbol, bits, extra = (np.zeros(32769, np.int64) for _ in range(3))
    at = 1
    for s in range(DISTANCES):
        n = max(0, s // 2 - 1)
        symbol[at : at + (1 << n)], bits[at : at + (1 << n)], extra[at : at + (1 << n)] = s, n, np.arange(1 << n)
        at += 1 << n
    return symbol, bits, extra


def limited_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of an optimal prefix code with no code over `limit`, by package-merge: a coin of each symbol in each of `limit` denominations, the cheapest 2n-2 taken."""
    if not counts:
        raise CompressionFailed("no symbols")
    if len(counts) > 1 << limit:
        raise CompressionFailed("too many symbols for the limit")
    by_count = sorted(range(len(counts)), key=counts.__getitem__)
    # twice the weight, and 1 for a package: a coin before a package of its weight
    coins = [counts[i] << 1 for i in by_count]
    levels, packages = [], []
    for _ in range(limit):
        levels.append(level := sorted(coins + packages))
        weights = [x >> 1 for x in level]
        if (following := [(x + y) << 1 | 1 for x, y in zip(weights[::2], weights[1::2], strict=False)]) == packages:
            break  # all further denominations are as this one
        packages = following
    levels += [levels[-1]] * (limit - len(levels))
    below, take = [0] * (len(counts) + 1), 2 * len(counts) - 2
    for level in reversed(levels):
        bought = sum(x & 1 for x in level[:take])
        below[take - bought] += 1
        take = 2 * bought
    out, n = [0] * len(counts), 0
    for i in range(len(counts) - 1, -1, -1):
        n += below[i + 1]
        out[by_count[i]] = n
    return out


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths by symbol; a lone symbol gets one bit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    out[used] = limited_lengths(counts[used].tolist(), limit) if len(used) > 1 else 1
    return out


@functools.cache
def _reversed() -> np.ndarray:
    """Numbers of 16 bits with their bits in reverse."""
    return np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8)).reshape(-1, 16)[:, ::-1], axis=1, bitorder="big").view(">u2").ravel().astype(np.int64)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by symbol, bits reversed for a stream that starts at the lowest bit."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used]
    counts = np.bincount(n, minlength=1).tolist()
    first, code, passed = [0], 0, 0
    for k in counts[1:]:
        code <<= 1
        first.append(code - passed)
        code, passed = code + k, passed + k
    codes = np.zeros(len(lengths), np.int64)
    codes[used] = _reversed()[np.array(first)[n] + np.arange(len(used))] >> (16 - n)
    return codes


@dataclass
class Code:
    literal: np.ndarray
    distance: np.ndarray

    @functools.cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        return canonical(self.literal), canonical(self.distance)


@functools.cache
def fixed_code() -> Code:
    return Code(np.repeat([8, 9, 7, 8], [144, 112, 24, 8]), np.full(DISTANCES, 5))


def frequencies(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Counts of literal and length symbols (with the end) and of distance symbols."""
    match = tokens.length > 0
    literal = np.bincount(tokens.value[~match], minlength=LITERALS) + np.bincount(length_symbols()[0][tokens.length[match]], minlength=LITERALS)
    literal[END] += 1
    return literal, np.bincount(distance_symbols()[0][tokens.value[match]], minlength=DISTANCES)


def build_code(literal: np.ndarray, distance: np.ndarray) -> Code:
    if not distance.any():
        distance = distance.copy()
        distance[0] = 1
    lengths = code_lengths(literal, 15), code_lengths(distance, 15)
    cut = [max(least, int(np.flatnonzero(x)[-1]) + 1) for x, least in zip(lengths, (257, 1), strict=True)]
    return Code(lengths[0][: cut[0]], lengths[1][: cut[1]])


class Bits:
    """A bit stream as parts: values and their widths, lowest bit first."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []

    def put(self, *pairs: tuple[int, int]) -> None:
        self.values.append(np.array([v for v, _ in pairs], np.int64))
        self.widths.append(np.array([w for _, w in pairs], np.int64))

    def put_arrays(self, values: np.ndarray, widths: np.ndarray) -> None:
        self.values.append(values)
        self.widths.append(widths)

    def __len__(self) -> int:
        return sum(int(w.sum()) for w in self.widths)


def packed(*streams: Bits) -> bytes:
    """Streams joined bit by bit, with no padding between them. Values have at most 31 bits and fit their widths."""
    values, widths = np.concatenate([x for s in streams for x in s.values]), np.concatenate([x for s in streams for x in s.widths])
    some = widths > 0
    values, widths = values[some].astype(np.uint64), widths[some]
    ends = np.cumsum(widths)
    size = int(ends[-1]) if len(ends) else 0
    begins = ends - widths
    # a value starts in one 32-bit word and may reach into the next; values have no bit in common, so words are sums
    placed = values << (begins & 31).astype(np.uint64)
    word, words = begins >> 5, (size >> 5) + 2
    out = np.bincount(word, (placed & np.uint64(0xFFFFFFFF)).astype(float), words) + np.bincount(word + 1, (placed >> np.uint64(32)).astype(float), words)
    return out.astype("<u4").tobytes()[: -(-size // 8)]


def _run_lengths(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as symbol, extra value, extra bits: runs of zeros are shortened, other lengths stand for themselves."""
    out = []
    for length, run in itertools.groupby(lengths):
        n = len(list(run))
        if length:
            out += [(length, 0, 0)] * n
            continue
        while n >= 11:
            k = min(n, 138)
            out.append((18, k - 11, 7))
            n -= k
        if n >= 3:
            out.append((17, n - 3, 3))
            n = 0
        out += [(0, 0, 0)] * n
    return out


def _header(bits: Bits, code: Code, final: bool) -> None:
    runs = np.array(_run_lengths([*code.literal.tolist(), *code.distance.tolist()]))
    counts = np.bincount(runs[:, 0], minlength=19)
    if np.count_nonzero(counts) < 2:
        counts[1 if counts[0] else 0] += 1
    lengths = code_lengths(counts, 7)
    codes = canonical(lengths)
    in_order = lengths[LENGTH_CODE_ORDER]
    told = max(3, int(np.flatnonzero(in_order)[-1])) + 1
    bits.put((int(final) | 4, 3), (len(code.literal) - 257, 5), (len(code.distance) - 1, 5), (told - 4, 4), *((n, 3) for n in in_order[:told].tolist()))
    bits.put_arrays(np.stack((codes[runs[:, 0]], runs[:, 1]), axis=1).ravel(), np.stack((lengths[runs[:, 0]], runs[:, 2]), axis=1).ravel())


def _body(bits: Bits, tokens: Tokens, code: Code, end: bool = True) -> None:
    literal_codes, distance_codes = code.codes
    match = tokens.length > 0
    ls, lb, lx = (t[tokens.length] for t in length_symbols())
    symbol = np.where(match, ls, tokens.value)
    far = np.where(match, tokens.value, 1)
    ds, db, dx = (t[far] for t in distance_symbols())
    zero = np.zeros(len(tokens), np.int64)
    here = np.minimum(ds, len(code.distance) - 1)
    values = np.stack((literal_codes[symbol], np.where(match, lx, zero), np.where(match, distance_codes[here], zero), np.where(match, dx, zero)), axis=1)
    widths = np.stack((code.literal[symbol], np.where(match, lb, zero), np.where(match, code.distance[here], zero), np.where(match, db, zero)), axis=1)
    bits.put_arrays(values.ravel(), widths.ravel())
    if end:
        bits.put((int(literal_codes[END]), int(code.literal[END])))


def dynamic_block(tokens: Tokens, final: bool, code: Code | None = None) -> Bits:
    bits = Bits()
    code = code or build_code(*frequencies(tokens))
    _header(bits, code, final)
    _body(bits, tokens, code)
    return bits


def fixed_block(tokens: list[Tokens], final: bool = True) -> Bits:
    """One block of all token lists."""
    bits = Bits()
    bits.put((int(final) | 2, 3))
    for i, t in enumerate(tokens):
        _body(bits, t, fixed_code(), end=i + 1 == len(tokens))
    return bits


def encode_blocks(blocks: list[Tokens], strategy: str = "Default", global_huffman: bool = False) -> bytes:
    """A whole DEFLATE stream."""
    blocks = blocks or [Tokens(np.zeros(0, np.uint16), np.zeros(0, np.uint16))]
    if sum(map(len, blocks)) > MOST_TOKENS:
        raise CompressionFailed("token stream too large")
    if strategy == "Fixed":
        return packed(fixed_block(blocks))
    code = None
    if global_huffman and len(blocks) > 1:
        code = build_code(*(sum(x) for x in zip(*map(frequencies, blocks), strict=True)))
    return packed(*(dynamic_block(b, i + 1 == len(blocks), code) for i, b in enumerate(blocks)))


def isolated_bytes(tokens: Tokens, strategy: str, final: bool) -> int:
    """Bytes of a block on its own."""
    return -(-len(fixed_block([tokens], final) if strategy == "Fixed" else dynamic_block(tokens, final)) // 8)


def deflate_bytes(data: bytes, max_chain: int = 128, nice: int = 128) -> bytes:
    """One buffer as one block."""
    from bytegrain.operators.lz import tokenize

    return encode_blocks([tokenize(data, 0, max_chain, nice)] if data else [])


def inflate(data: bytes, size: int | None = None) -> bytes:
    """Raw DEFLATE decoded; raises ValueError on a broken, cut or overlong stream. Not more than a byte over `size` is ever held."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, size + 1) if size is not None else d.decompress(data) + d.flush()
    except zlib.error as e:
        raise ValueError(f"inflate: {e}") from None
    if size is not None and len(out) > size:
        raise ValueError(f"inflate: more than the {size} bytes expected")
    if not d.eof or d.unused_data:
        raise ValueError("inflate: stream ends too early" if not d.eof else "inflate: data after the stream")
    if size is not None and len(out) != size:
        raise ValueError(f"inflate: {len(out)} bytes, {size} expected")
    return out


def stock_deflate(data: bytes, level: int = 6) -> bytes:
    """The stock codec's raw stream, to compare with."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()
