"""Compressing one entry from its blocks: what block and entry kernels run."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from bytegrain.config import Profile
from bytegrain.errors import RETRYABLE
from bytegrain.functions.kernels import half_up, raw
from bytegrain.operators.blocks import cut_entry
from bytegrain.operators.deflate import encode_blocks, isolated_bytes
from bytegrain.operators.lz import WINDOW, Task, Tokens, indexed_positions, tokenize_all, tokenize_searches
from bytegrain.operators.plan_entry import EntryPlan, Model, plan_entry


@dataclass
class Block:
    """A block with what may be matched before it."""

    number: int
    offset: int
    length: int
    data: bytes  # up to WINDOW bytes before the block, then the block
    indexed: bytes | None  # a flag for each byte of data


def cut_blocks(data: bytes, target: int, p: Profile, m: Model) -> list[Block]:
    held = indexed_positions(raw(data), max(m.stride, 1)) if m.use_index and len(data) else None
    out = []
    for i, (at, n) in enumerate(cut_entry(data, len(data), target, p)):
        begin = max(0, at - WINDOW)
        out.append(Block(i, at, n, data[begin : at + n], held[begin : at + n].tobytes() if held is not None else None))
    return out


def _task(b: Block, chain: int, nice: int) -> Task:
    return Task(b.data, len(b.data) - b.length, chain, nice, np.frombuffer(b.indexed, bool) if b.indexed is not None else None)


def match_block(b: Block, chain: int, nice: int) -> Tokens:
    return tokenize_all([_task(b, chain, nice)])[0]


#: Bytes of blocks that are matched side by side; a larger block goes alone.
TOGETHER = 1 << 17


def match_searches(blocks: list[tuple[Block, list[tuple[int, int]]]]) -> Iterator[list[list[Tokens]]]:
    """For blocks in order the tokens of each search (chain and nice), a few blocks at a time: small ones share the cost of array operations, searches that of sorts."""
    at = 0
    while at < len(blocks):
        end, size = at + 1, len(blocks[at][0].data)
        while end < len(blocks) and size + len(blocks[end][0].data) <= TOGETHER:
            size += len(blocks[end][0].data)
            end += 1
        yield tokenize_searches([_task(b, 0, 0) for b, _ in blocks[at:end]], [searches for _, searches in blocks[at:end]])
        at = end


def match_together(blocks: list[tuple[Block, int, int]]) -> Iterator[list[Tokens]]:
    """Tokens of blocks (with chain and nice) in order, a few blocks at a time."""
    for some in match_searches([(b, [(chain, nice)]) for b, chain, nice in blocks]):
        yield [found for found, in some]


def _longer(chain: int, nice: int) -> tuple[int, int]:
    return min(half_up(chain * 1.06), 1024), min(half_up(nice * 1.04), 258)


def match_adaptively(blocks: Iterable[Block], chain: int, nice: int, predicted: float, match: Callable[[Block, int, int], Tokens] = match_block) -> list[Tokens]:
    """Blocks one after another: more tokens than told shorten the search for the next block, fewer lengthen it."""
    out = []
    for b in blocks:
        t = match(b, chain, nice)
        out.append(t)
        actual = len(t) / max(b.length, 1)
        if b.length >= 4096 and actual > predicted * 1.12:
            chain, nice = max(half_up(chain * 0.88), 48), max(half_up(nice * 0.92), 32)
        elif b.length >= 4096 and actual < predicted * 0.92:
            chain, nice = _longer(chain, nice)
    return out


@dataclass
class Encoded:
    method: str  # what the payload really is
    payload: bytes
    crc32: int
    trace: list[dict]


def encode_entry(data: bytes, blocks: list[Block], tokens: list[Tokens], plan: EntryPlan, p: Profile, trace: bool = False) -> Encoded:
    """The entry's payload. A failing encoder is followed by a plainer one: fixed codes, then stored; the method is that of the payload kept."""
    crc = zlib.crc32(data)
    if plan.method(p) == "Stored":
        return Encoded("Stored", data, crc, [])
    strategy, shared = plan.strategy(p), plan.global_huffman(p)
    try:
        payload = encode_blocks(tokens, strategy, shared)
    except RETRYABLE:
        try:
            strategy, shared = "Fixed", False
            payload = encode_blocks(tokens, strategy)
        except RETRYABLE:
            return Encoded("Stored", data, crc, [])
    rows, total = [], sum(b.length for b in blocks)
    if trace:
        for i, (b, t) in enumerate(zip(blocks, tokens, strict=True)):
            if len(blocks) == 1:
                size = len(payload)
            else:
                size = len(payload) * b.length // total if shared else isolated_bytes(t, strategy, i + 1 == len(blocks))
            rows.append({"block_id": b.number, "offset": b.offset, "raw_bytes": b.length, "compressed_bytes": size, "token_count": len(t), "predicted_ratio": plan.predicted_ratio(p), "actual_ratio": size / b.length, "matches_window": t.from_window, "matches_index": t.from_index, "fallback_code": 0})
    return Encoded("Deflate", payload, crc, rows)


def is_adaptive(blocks: int, plan: EntryPlan, p: Profile) -> bool:
    return p.adaptive and blocks > 1 and not plan.global_huffman(p)


def compress_entry(data: bytes, m: Model, p: Profile, trace: bool = False) -> tuple[EntryPlan, Encoded]:
    """All steps for one entry in one place, for tests and small archives."""
    plan = plan_entry(data, m, p)
    if plan.method(p) == "Stored":
        return plan, encode_entry(data, [], [], plan, p)
    blocks = cut_blocks(data, plan.target, p, m)
    chain, nice = plan.chain(p, m), plan.nice(p, m)
    tokens = match_adaptively(blocks, chain, nice, plan.predicted_ratio(p)) if is_adaptive(len(blocks), plan, p) else [match_block(b, chain, nice) for b in blocks]
    return plan, encode_entry(data, blocks, tokens, plan, p, trace)


def compress_each(contents: list[bytes], runs: list[tuple[Profile, Model]]) -> Iterator[list[Encoded]]:
    """What compress_entry() makes of each content under each profile. Blocks that several profiles cut alike are sorted once for all searches, and searched once by those that search alike; small ones go side by side."""
    cuts, todo, tokens = {}, {}, {}
    plans = [[plan_entry(data, m, p) for p, m in runs] for data in contents]

    def cut(i: int, r: int) -> tuple[tuple, list[Block]]:
        p, m = runs[r]
        key = (i, plans[i][r].target, p.min_block, p.max_block, m.stride if m.use_index else None)
        if key not in cuts:
            cuts[key] = cut_blocks(contents[i], plans[i][r].target, p, m)
        return key, cuts[key]

    # searches of blocks: first those that are known, then what adaptive runs come to if every block has fewer tokens than told
    follow = []
    for i, r in itertools.product(range(len(contents)), range(len(runs))):
        (p, m), plan = runs[r], plans[i][r]
        if plan.method(p) == "Stored":
            continue
        key, blocks = cut(i, r)
        search = plan.chain(p, m), plan.nice(p, m)
        if is_adaptive(len(blocks), plan, p):
            follow.append((key, blocks, search))
            continue
        for b in blocks:
            todo.setdefault((key, b.number), (b, {}))[1][search] = None
    for key, blocks, search in follow:
        for b in blocks:
            if (key, b.number) in todo:
                todo[key, b.number][1][search] = None
            search = _longer(*search) if b.length >= 4096 else search
    matched = itertools.chain.from_iterable(match_searches([(b, list(searches)) for b, searches in todo.values()]))
    for (key, number), (_, searches), found in zip(todo, todo.values(), matched, strict=True):
        tokens |= {(key, number, *search): t for search, t in zip(searches, found, strict=True)}

    def encoded(i: int, r: int) -> Encoded:
        (p, m), plan = runs[r], plans[i][r]
        if plan.method(p) == "Stored":
            return encode_entry(contents[i], [], [], plan, p)
        (key, blocks), chain, nice = cut(i, r), plan.chain(p, m), plan.nice(p, m)

        def known(b: Block, chain: int, nice: int) -> Tokens:
            if (k := (key, b.number, chain, nice)) not in tokens:
                tokens[k] = match_block(b, chain, nice)
            return tokens[k]

        found = match_adaptively(blocks, chain, nice, plan.predicted_ratio(p), known) if is_adaptive(len(blocks), plan, p) else [known(b, chain, nice) for b in blocks]
        return encode_entry(contents[i], blocks, found, plan, p)

    for i in range(len(contents)):
        yield [encoded(i, r) for r in range(len(runs))]
