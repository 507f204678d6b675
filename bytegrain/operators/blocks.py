"""Block plans: where an entry is cut."""

from __future__ import annotations

import math

import numpy as np

from bytegrain.config import Profile
from bytegrain.functions.kernels import raw, window_entropy


def cut_entry(data: bytes | None, size: int, target: int, p: Profile) -> list[tuple[int, int]]:
    """offset and length of each block: contiguous, without gaps. Without data the cuts are `target` apart."""
    block = min(max(target, p.min_block), p.max_block)
    whole = raw(data) if data is not None and len(data) >= size else None
    repeats = np.concatenate(([0], np.cumsum(whole[1:] == whole[:-1]))) if whole is not None and len(whole) else None
    cuts, at = [], 0
    while at < size:
        soft, cap = min(size, at + block), min(size, at + p.max_block)
        end = _best_cut(whole, repeats, at, min(soft, cap), cap, p.min_block) if whole is not None and cap > at + p.min_block else min(soft, cap)
        cuts.append((at, end - at))
        at = end
    return cuts


def _share(repeats: np.ndarray, first: int, last: int) -> float:
    """Share of repeated bytes in first..last-1."""
    return float(repeats[last - 1] - repeats[first]) / (last - first - 1) if last > first + 1 else 0.0


def _best_cut(data: np.ndarray, repeats: np.ndarray, at: int, soft: int, cap: int, least: int) -> int:
    """The cut after which statistics change most: entropy of what follows against what precedes, and a third of the change in repeats."""
    low = at + least
    before = window_entropy(data, at, low)  # both sides look at their first bytes only, and the left side has enough of them at once
    best, score = min(max(soft, low), cap), -math.inf
    for cut in range(low, cap, max((cap - low) // 128, 32)):
        s = abs(window_entropy(data, cut, cap) - before) + 0.35 * abs(_share(repeats, cut, cap) - _share(repeats, at, cut))
        if s > score:
            best, score = cut, s
    return best if score > 2.220446049250313e-16 else min(max(soft, low), cap)
