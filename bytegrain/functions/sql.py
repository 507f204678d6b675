"""Column expressions: byte measures and decisions that Catalyst can evaluate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytegrain.config import Profile


def payload(text: Column) -> Column:
    """A text column as bytes."""
    return F.encode(text, "UTF-8")


def byte_class(byte: Column) -> Column:
    return F.when(byte == 0, "zero").when(byte.between(0x21, 0x7E) | byte.isin(9, 10, 13), "ascii_text").otherwise("high_entropy")


def bytes_of(content: Column, cap: int | None = None) -> Column:
    """The bytes as an array of ints; unhexed pairs, since Spark's bytes are signed."""
    content = content if cap is None else F.substring(content, 1, cap)
    pairs = F.regexp_extract_all(F.hex(content), F.lit("(..)"))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def match_strength(entropy: Column, repeat: Column, bigram: Column) -> Column:
    return F.greatest(repeat * 2.4 + bigram * 1.6 + (8.0 - clamp(entropy, 0.0, 8.0)) * 0.35, F.lit(0.0))


def recommend_stored(size: Column, entropy: Column, strength: Column, p: Profile) -> Column:
    """Is the entry better left uncompressed?"""
    if p.method == "Stored" or p.mode == "Off":
        return F.lit(p.method == "Stored")
    least = {"Safe": 1.85, "Balanced": 1.35, "Aggressive": 0.95}[p.planning]
    gain = strength / F.greatest(entropy + 0.25, F.lit(0.25))
    return (size < 150) | ((size < 2048) & (entropy > 7.2) & (gain < least * 0.6)) | ((gain < least) & (entropy > 6.0))


def deflate_path(entropy: Column, strength: Column, p: Profile) -> Column:
    if p.mode == "Off":
        return F.lit("Auto")
    lifted = strength + {"Aggressive": 0.35, "Standard": 0.2}[p.mode]
    bias = {"Safe": 1.15, "Balanced": 1.0, "Aggressive": 0.85}[p.planning]
    return F.when(lifted * bias > 2.8 - entropy * 0.12, "Dynamic").when((entropy < 4.5) & (lifted > 1.1), "Fixed").otherwise("Auto")


def target_block(size: Column, entropy: Column, repeat: Column, model_block: Column, p: Profile) -> Column:
    low, high = F.lit(p.min_block).cast("long"), F.lit(p.max_block).cast("long")
    b = model_block.cast("long")
    if p.mode != "Off":
        b = F.when((repeat > 0.22) & (entropy < 5.5), F.least(b * 3, high)).when(entropy > 7.2, F.greatest(F.floor(b / 2), low)).otherwise(b)
        if p.mode == "Aggressive":
            b = F.when(repeat > 0.12, F.greatest(F.floor(F.least(b * 5, high) / 4), low)).otherwise(b)
        if p.planning == "Safe":
            b = F.least(b, F.lit(max(p.max_block // 2, p.min_block)).cast("long"))
    return F.least(clamp(b, low, high), F.greatest(size.cast("long"), F.lit(1).cast("long")))


def chain_multiplier(strength: Column, p: Profile) -> Column:
    m = {"Off": 1.0, "Standard": 1.08, "Aggressive": 1.25}[p.mode] * {"Safe": 0.88, "Balanced": 1.0, "Aggressive": 1.12}[p.planning]
    return clamp(clamp(strength * 0.08 + 0.85, 0.75, 1.35) * m, 0.5, 1.75)


def huffman_hint(size: Column, target: Column, repeat: Column, p: Profile) -> Column:
    """Is one code for all blocks of the entry worth while?"""
    if p.mode == "Off":
        return F.lit(False)
    return (F.floor(size / F.greatest(target, F.lit(1).cast("long"))) >= 2) & (repeat > 0.08)


def max_chain(model_chain: Column, multiplier: Column) -> Column:
    return clamp(F.round(model_chain * multiplier), 16.0, 256.0).cast("int")


def nice_match(model_nice: Column, strength: Column) -> Column:
    return clamp(F.round(model_nice * (F.lit(0.82) + F.least(strength, F.lit(3.0)) * 0.18 / 3.0)), 16.0, 258.0).cast("int")


def predicted_ratio(entropy: Column) -> Column:
    return clamp(entropy / 8, 0.06, 1.0)


def estimated_ratio(entropy: Column) -> Column:
    return clamp(entropy / 8, 0.05, 1.2)


def decode_ns_per_byte(repeat: Column) -> Column:
    return repeat * 6.0 + 2.5


def match_dominance(window: Column, index: Column) -> Column:
    gap = F.abs(window.cast("double") - index) / F.greatest(window, index, F.lit(1))
    return F.when(gap <= 0.12, "balanced").when(window > index, "window-dominant").otherwise("index-dominant")


def block_fallback(code: Column, actual: Column, predicted: Column, raw_bytes: Column) -> Column:
    """Why a block did worse than told; empty if it didn't."""
    return F.when(code != 0, F.concat(F.lit("code_"), code.cast("string"))).when((actual > predicted * 1.15) & (raw_bytes >= 4096), "dynamic_not_beneficial").otherwise("")


def method_label(stored: Column, path: Column) -> Column:
    return F.when(stored, "stored").otherwise(F.concat(F.lit("deflate:"), path))


def rate_mib_s(n_bytes: Column, milliseconds: Column) -> Column:
    return n_bytes / (1 << 20) / (F.greatest(milliseconds, F.lit(1)) / 1000)
