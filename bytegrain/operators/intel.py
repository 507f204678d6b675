"""Signals, the archive model, and each entry's decisions and estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytegrain.config import KIB, MIB, Profile
from bytegrain.functions import kernels as K
from bytegrain.functions import sql as S
from bytegrain.operators.plan_entry import SHORTCUT_BELOW

_SIGNALS = "entropy_bits double, repeat_density double, bigram_proxy double, zero long, ascii_text long, high_entropy long"


def signals(entries: DataFrame, p: Profile = Profile(), keep_content: bool = False) -> DataFrame:
    """entries with byte measures: one pass over the content, which only the kernel reads; without keep_content it goes no further."""
    at, cap = entries.columns.index("content"), p.sample_cap
    kept = [f for f in entries.schema.fields if keep_content or f.name != "content"]
    names = [f.name for f in kept]
    fields = T.StructType.fromDDL(_SIGNALS).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(at):
                b = K.raw(content.as_buffer() or b"")
                rows.append((*K.signals(b), *K.class_counts(b[:cap])))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.float64()] * 3 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*names, *(f.name for f in fields)])

    return entries.mapInArrow(run, T.StructType([*kept, *fields]))


def pattern_counts(entries: DataFrame, cap: int | None) -> DataFrame:
    """pos, byte, n: how often each byte stands at each of the first `cap` positions (with None, anywhere: pos 0), counted in each task; rows are to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, found = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            every, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
            return every, np.bincount(at, np.concatenate((counts, found)), len(every)).astype(np.int64)

        for batch in batches:
            for content in batch.column(0):
                b = K.raw(content.as_buffer() or b"").astype(np.int64)
                held.append(b if cap is None else (np.arange(min(cap, len(b))) << 8) | b[:cap])
                n += len(held[-1])
                if n >= 1 << 22:
                    keys, counts = merged()
                    held, n = [], 0
        keys, counts = merged()
        for at in range(0, len(keys), 1 << 16):
            k = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k >> 8), pa.array(k & 255), pa.array(counts[at : at + (1 << 16)])], names=["pos", "byte", "n"])

    return entries.select("content").mapInArrow(run, "pos long, byte long, n long")


def prior_matches(entries: DataFrame, reach: int = 32768) -> DataFrame:
    """logical_name, positions, buckets, matches, least_distance: an entry's 3-byte strings by bucket, and those with an earlier one of their bucket in reach. Content stays where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(1):
                keys = K.bucket(K.raw(content.as_buffer() or b""))
                order = np.argsort(keys, kind="stable")
                same = keys[order][1:] == keys[order][:-1]
                distance = np.diff(order)[same]
                rows.append((len(keys), len(keys) - int(same.sum()), int((distance <= reach).sum()), int(distance.min(initial=1 << 62)) if len(distance) else -1))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["logical_name", "positions", "buckets", "matches", "least_distance"])

    return entries.select("logical_name", "content").mapInArrow(run, "logical_name string, positions long, buckets long, matches long, least_distance long")


def archive_model(measured: DataFrame, p: Profile = Profile(), shortcut: bool = False) -> DataFrame:
    """One row: totals, byte classes, and the tuning that follows from them."""
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)

    sums = measured.agg(F.count(F.lit(1)).alias("entry_count"), total("uncompressed_size"), total("zero"), total("ascii_text"), total("high_entropy"))
    sums = sums.withColumnRenamed("uncompressed_size", "total_uncompressed").withColumnRenamed("ascii_text", "text_mass")
    mean = F.when(F.col("entry_count") == 0, 0).otherwise(F.floor(F.col("total_uncompressed") / F.greatest("entry_count", F.lit(1))))
    wide = F.when(F.col("text_mass") > 0, min(p.base_block * 2, p.max_block)).otherwise(p.base_block)
    wanted = F.when(F.col("mean_entry_bytes") < 256 * KIB, max(p.min_block, p.base_block // 4)).otherwise(wide)
    merged = S.clamp(F.least(wanted, F.lit(max(p.sample_cap, 4096) * 4)), p.min_block, p.max_block)
    spread = F.greatest(F.floor(F.lit(p.max_block) / F.greatest("entry_count", F.lit(1))), F.lit(p.min_block))
    small = F.lit(shortcut) & (F.col("total_uncompressed") < SHORTCUT_BELOW)
    return sums.withColumn("mean_entry_bytes", mean.cast("long")).withColumns({
        "duplicate_mass": F.lit(0).cast("long"),
        "suggested_block_bytes": F.when(small, p.base_block).otherwise(S.clamp(F.least(merged, spread), p.min_block, p.max_block)).cast("long"),
        "lz77_max_chain": F.when(small, 128).otherwise(64),
        "lz77_nice_match": F.when(small | (F.col("mean_entry_bytes") > MIB), 128).otherwise(64),
        "index_stride": F.when(small, 1).otherwise(2),
        "use_index": F.col("entry_count") <= 4,
    })


MODEL_COLUMNS = ["entry_count", "total_uncompressed", "text_mass", "duplicate_mass", "suggested_block_bytes", "lz77_max_chain", "lz77_nice_match", "index_stride", "use_index"]


def decide(measured: DataFrame, model: DataFrame, p: Profile = Profile()) -> DataFrame:
    """measured with each entry's decisions; the model is one row, so joining it costs nothing."""
    out = measured.crossJoin(F.broadcast(model.select(*(F.col(c).alias(f"m_{c}") for c in MODEL_COLUMNS))))
    n, h, r = F.col("uncompressed_size"), F.col("entropy_bits"), F.col("repeat_density")
    out = out.withColumn("match_strength_proxy", S.match_strength(h, r, F.col("bigram_proxy")))
    s = F.col("match_strength_proxy")
    out = out.withColumns({
        "duplicate_proxy": F.least(F.greatest("m_duplicate_mass", F.lit(1)) / F.greatest("m_text_mass", F.lit(1)), F.lit(8.0)),
        "predicted_stored": S.recommend_stored(n, h, s, p),
        "predicted_deflate_path": S.deflate_path(h, s, p),
        "target_block_bytes": S.target_block(n, h, r, F.col("m_suggested_block_bytes"), p),
        "lz77_chain_mult": S.chain_multiplier(s, p),
        "est_compressed_ratio": S.estimated_ratio(h),
        "est_decode_ns_per_byte": S.decode_ns_per_byte(r),
    })
    return out.withColumn("use_global_huffman", S.huffman_hint(n, F.col("target_block_bytes"), r, p))


INTEL_COLUMNS = ["logical_name", "uncompressed_size", "entropy_bits", "repeat_density", "bigram_proxy", "duplicate_proxy", "match_strength_proxy", "predicted_stored", "predicted_deflate_path", "target_block_bytes", "lz77_chain_mult", "use_global_huffman", "est_compressed_ratio", "est_decode_ns_per_byte"]


def intel(entries: DataFrame, p: Profile = Profile(), shortcut: bool = False) -> DataFrame:
    """The analysis table: one row for each entry. Content is read by the two scans of signals() only and never shuffled."""
    measured = signals(entries, p)
    return decide(measured, archive_model(measured, p, shortcut), p).select(*INTEL_COLUMNS)


def intel_summary(rows: DataFrame) -> DataFrame:
    """One row: entries, bytes, weighted entropy and predicted ratio."""
    n = F.col("uncompressed_size")
    total = F.coalesce(F.sum(n), F.lit(0)).cast("long")

    def weighted(c: str) -> Column:
        return F.when(total > 0, F.sum(F.col(c) * n) / total).otherwise(0.0)

    return rows.agg(F.count(F.lit(1)).alias("entry_count"), total.alias("total_raw_bytes"), weighted("entropy_bits").alias("global_entropy_bits"), weighted("est_compressed_ratio").alias("predicted_ratio"), F.lit(0.0).alias("duplicate_cluster_score"))
