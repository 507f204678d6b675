"""Structured Streaming forms: signals and decisions of arriving payloads, and windowed totals with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.config import Profile
from bytegrain.operators.intel import MODEL_COLUMNS, decide, signals
from bytegrain.sources.entries import from_table


def stream_intel(stream: DataFrame, model: DataFrame, *, key: str, payload: str, p: Profile = Profile()) -> DataFrame:
    """Decisions for each arriving row, stateless; the model is a batch row, from an earlier archive or a sample."""
    return decide(signals(from_table(stream, key, payload), p), model.select(*MODEL_COLUMNS), p)


def windowed_signals(stream: DataFrame, *, time: str, key: str, payload: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Totals by event-time window: rows, bytes, weighted entropy, and repeated ids inside the watermark counted once."""
    kept = stream.select(F.col(time).alias("at"), F.col(key).cast("string").alias("logical_name"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("content")).withWatermark("at", late).dropDuplicatesWithinWatermark(["logical_name"])
    sized = kept.select("at", "logical_name", F.octet_length("content").cast("long").alias("uncompressed_size"), "content")
    measured = signals(sized)
    n = F.col("uncompressed_size")
    return measured.groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("entries"), F.sum(n).alias("bytes"), (F.sum(F.col("entropy_bits") * n) / F.sum(n)).alias("entropy_bits")).select(F.col("window.start").alias("start"), "entries", "bytes", "entropy_bits")
