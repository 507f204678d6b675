"""Predicted against actual: nested reports of archive, files and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.config import Profile
from bytegrain.functions import sql as S
from bytegrain.operators.archive import compress
from bytegrain.operators.intel import intel, intel_summary
from bytegrain.operators.stored import stored

_BLOCKS = "array<struct<id: long, offset: long, length: long, predicted: string, actual: string, predicted_ratio: double, actual_ratio: double, matches: struct<window: long, index: long>, match_dominance: string, fallback: boolean, fallback_reason: string, lz77_tokens: long, compressed_bytes: long>>"


def explain_blocks(trace: DataFrame) -> DataFrame:
    """logical_name and its explained blocks, nested in order."""
    reason = S.block_fallback(F.col("fallback_code"), F.col("actual_ratio"), F.col("predicted_ratio"), F.col("raw_bytes"))
    row = F.struct(
        F.col("block_id").alias("id"), "offset", F.col("raw_bytes").alias("length"), F.format_string("%.6f", "predicted_ratio").alias("predicted"), F.format_string("%.6f", "actual_ratio").alias("actual"), "predicted_ratio", "actual_ratio",
        F.struct(F.col("matches_window").alias("window"), F.col("matches_index").alias("index")).alias("matches"), S.match_dominance(F.col("matches_window"), F.col("matches_index")).alias("match_dominance"),
        (reason != "").alias("fallback"), reason.alias("fallback_reason"), F.col("token_count").alias("lz77_tokens"), "compressed_bytes",
    )
    return trace.select("logical_name", row.alias("b")).groupBy("logical_name").agg(F.array_sort(F.collect_list("b")).cast(_BLOCKS).alias("blocks"))


def explain_files(rows: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """intel()'s rows beside what a run (compress() with trace) did; without a run the actual side is empty."""
    base = rows.select(F.col("logical_name").alias("name"), F.col("uncompressed_size").alias("size"), F.col("entropy_bits").alias("entropy"), S.method_label(F.col("predicted_stored"), F.col("predicted_deflate_path")).alias("predicted"), F.col("est_compressed_ratio").alias("predicted_ratio"))
    if packed is None:
        return base.select("*", F.lit("").alias("actual"), F.lit(0.0).alias("actual_ratio"), F.array().cast(_BLOCKS).alias("blocks"))
    trace = packed.select("logical_name", F.explode("trace").alias("t")).select("logical_name", "t.*")
    ratio = F.when(F.col("uncompressed_size") > 0, F.col("compressed_size") / F.col("uncompressed_size")).otherwise(0.0)
    run = packed.select("logical_name", F.when(F.col("stored_effective"), "stored").otherwise("deflate").alias("actual"), ratio.alias("actual_ratio")).join(explain_blocks(trace), "logical_name", "left").withColumnRenamed("logical_name", "name")
    return base.join(run, "name", "left").select(*base.columns, F.coalesce("actual", F.lit("")).alias("actual"), F.coalesce("actual_ratio", F.lit(0.0)).alias("actual_ratio"), F.coalesce("blocks", F.array().cast(_BLOCKS)).alias("blocks"))


def explain(entries: DataFrame, p: Profile = Profile(), run: bool = True, packed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The archive's row, and a row for each file. The model behind predictions takes no shortcut for small archives; a run's does."""
    rows = intel(entries, p)
    if run and packed is None:
        packed = stored(compress(entries, p, trace=True).drop("payload"))  # read for the sizes and for the trace
    archive = intel_summary(rows).select(F.col("global_entropy_bits").alias("entropy"), F.lit(p.strategy).alias("strategy"), F.lit(p.global_huffman).alias("global_huffman"), "predicted_ratio")
    if packed is None:
        return archive.withColumn("actual_ratio", F.lit(0.0)), explain_files(rows)
    done = packed.agg((F.sum("compressed_size") / F.sum("uncompressed_size")).alias("actual_ratio")).select(F.coalesce("actual_ratio", F.lit(0.0)).alias("actual_ratio"))
    return archive.crossJoin(F.broadcast(done)), explain_files(rows, packed)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON text, for JSON sinks."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
