"""Signals and decisions of one entry in plain Python: what kernels need row by row. functions.sql says the same as columns, and a test holds both together."""

from __future__ import annotations

from dataclasses import dataclass

from bytegrain.config import KIB, MIB, Profile
from bytegrain.functions.kernels import half_up, match_strength, signals

SHORTCUT_BELOW = 64 * KIB


@dataclass(frozen=True)
class Model:
    """Archive-wide statistics and what follows from them."""

    entries: int
    total: int
    text_mass: int = 0
    duplicate_mass: int = 0
    zero: int = 0
    high_entropy: int = 0
    block: int = 256 * KIB
    chain: int = 128
    nice: int = 128
    stride: int = 1

    @property
    def use_index(self) -> bool:
        return self.entries <= 4 or self.duplicate_mass / max(self.total, 1) > 0.04


def model_of(entries: int, total: int, zero: int, text: int, other: int, p: Profile, shortcut: bool) -> Model:
    """The model of an archive. With `shortcut`, a small archive gets the defaults (as creating one does; analysing one doesn't)."""
    if shortcut and total < SHORTCUT_BELOW:
        return Model(entries, total)
    mean = total // entries if entries else 0
    base = min(p.base_block * 2, p.max_block) if text > 0 else p.base_block
    wanted = max(p.min_block, p.base_block // 4) if mean < 256 * KIB else base
    merged = min(max(min(wanted, max(p.sample_cap, 4096) * 4), p.min_block), p.max_block)
    block = min(max(min(merged, max(p.max_block // max(entries, 1), p.min_block)), p.min_block), p.max_block)
    return Model(entries, total, text, 0, zero, other, block, 64, 128 if mean > MIB else 64, 2)


@dataclass(frozen=True)
class EntryPlan:
    entropy: float
    repeat: float
    bigram: float
    strength: float
    stored: bool
    path: str
    target: int
    multiplier: float
    huffman: bool

    def method(self, p: Profile) -> str:
        return "Stored" if p.method == "Stored" or (p.mode != "Off" and self.stored) else "Deflate"

    def strategy(self, p: Profile) -> str:
        return {"Auto": p.strategy, "Dynamic": "Default", "Fixed": "Fixed"}[self.path] if p.mode != "Off" else p.strategy

    def global_huffman(self, p: Profile) -> bool:
        return p.global_huffman or (p.mode != "Off" and self.huffman)

    def chain(self, p: Profile, m: Model) -> int:
        return m.chain if p.mode == "Off" else min(max(half_up(m.chain * self.multiplier), 16), 256)

    def nice(self, p: Profile, m: Model) -> int:
        return m.nice if p.mode == "Off" else min(max(half_up(m.nice * (0.82 + 0.18 * min(self.strength, 3.0) / 3.0)), 16), 258)

    def predicted_ratio(self, p: Profile) -> float:
        return 0.72 if p.mode == "Off" else min(max(self.entropy / 8, 0.06), 1.0)


def plan_entry(data: bytes, m: Model, p: Profile) -> EntryPlan:
    h, r, b = signals(data)
    s, n = match_strength(h, r, b), len(data)
    on = p.mode != "Off"
    thr = {"Safe": 1.85, "Balanced": 1.35, "Aggressive": 0.95}[p.planning]
    gain = s / max(h + 0.25, 0.25)
    stored = p.method == "Stored" or (on and (n < 150 or (n < 2048 and h > 7.2 and gain < thr * 0.6) or (gain < thr and h > 6.0)))
    path = "Auto"
    if on:
        lifted = s + {"Aggressive": 0.35, "Standard": 0.2}[p.mode]
        bias = {"Safe": 1.15, "Balanced": 1.0, "Aggressive": 0.85}[p.planning]
        path = "Dynamic" if lifted * bias > 2.8 - h * 0.12 else "Fixed" if h < 4.5 and lifted > 1.1 else "Auto"
    block = m.block
    if on:
        if r > 0.22 and h < 5.5:
            block = min(block * 3, p.max_block)
        elif h > 7.2:
            block = max(block // 2, p.min_block)
        if p.mode == "Aggressive" and r > 0.12:
            block = max(min(block * 5, p.max_block) // 4, p.min_block)
        if p.planning == "Safe":
            block = min(block, max(p.max_block // 2, p.min_block))
    target = min(min(max(block, p.min_block), p.max_block), max(n, 1))
    lift = {"Off": 1.0, "Standard": 1.08, "Aggressive": 1.25}[p.mode] * {"Safe": 0.88, "Balanced": 1.0, "Aggressive": 1.12}[p.planning]
    multiplier = min(max(lift * min(max(0.85 + s * 0.08, 0.75), 1.35), 0.5), 1.75)
    return EntryPlan(h, r, b, s, stored, path, target, multiplier, on and max(n // max(target, 1), 1) >= 2 and r > 0.08)
