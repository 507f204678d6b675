"""Profiles: the settings that change results."""

from __future__ import annotations

from dataclasses import dataclass, replace

KIB, MIB = 1 << 10, 1 << 20

MODES = ("Off", "Standard", "Aggressive")
PLANNING = ("Safe", "Balanced", "Aggressive")
VERIFICATION = ("Off", "AfterWrite", "Strict")
LAYOUTS = ("lexical", "size_desc", "global_score")


@dataclass(frozen=True)
class Profile:
    """level only reaches the stock codecs that results are compared with."""

    method: str = "Deflate"
    strategy: str = "Default"
    level: int = 6
    global_huffman: bool = False
    adaptive: bool = False
    mode: str = "Standard"
    planning: str = "Balanced"
    verification: str = "AfterWrite"
    layout: str = "lexical"
    base_block: int = 256 * KIB
    min_block: int = 32 * KIB
    max_block: int = 4 * MIB
    min_sample: int = 4096
    max_sample: int = 256 * KIB

    def __post_init__(self) -> None:
        for value, known in ((self.method, ("Deflate", "Stored")), (self.strategy, ("Default", "Fixed", "Filtered", "HuffmanOnly", "Rle")), (self.mode, MODES), (self.planning, PLANNING), (self.verification, VERIFICATION), (self.layout, LAYOUTS)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")
        if not 1 <= self.level <= 9:
            raise ValueError("level is 1 to 9")

    def but(self, **changes) -> Profile:
        return replace(self, **changes)

    @property
    def sample_cap(self) -> int:
        return max(self.max_sample, self.min_sample)


#: A bare library profile: no prediction.
PLAIN = Profile(mode="Off", verification="Off", planning="Safe")

# Names of the modes of the comparison matrix. Scheduling is Spark's, so m04 differs from m01 in name only.
MODE_TABLE = [
    ("m01_standard_create", Profile()),
    ("m02_predictive_off", Profile(mode="Off")),
    ("m03_predictive_aggressive", Profile(mode="Aggressive")),
    ("m04_scheduler_throughput_biased", Profile()),
    ("m05_planning_safe", Profile(planning="Safe")),
    ("m06_verification_off", Profile(verification="Off")),
    ("m07_verification_strict", Profile(verification="Strict")),
    ("m08_global_huffman_on", Profile(global_huffman=True)),
    ("m09_adaptive_on_global_huffman_off", Profile(adaptive=True)),
    ("m10_combo_adapt_gh_verify_strict", Profile(adaptive=True, global_huffman=True, verification="Strict")),
]
