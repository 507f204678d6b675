"""Exact deduplication by progressive refinement: group by length, then by prefix hash, then by full hash.

Only DataFrame functions run. Two scans read the texts:

1. Length and prefix hash of every text, kept as a table of 16-byte rows. Lengths
   that occur once, then (length, prefix hash) pairs that occur once, are dropped
   by aggregates with map-side combining, so a hot length or prefix costs one row
   a task. The surviving pairs become a bit table of fixed size (`bits`).
2. The full hash, only for texts whose pair may survive (a false positive costs
   one hash, never a wrong result; with `digest` all texts are hashed, for callers
   that want the digest). Texts are never shuffled: only (id, length, hash) are.

Equal texts are those that are identical after each run of white space is
replaced by one space (`normalize=False`: byte for byte). The row with the
smallest id stays.

Defined results: a null text counts as empty; null ids sort last; of rows equal in
text and id exactly one stays; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrain.llm._shared import stored

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalized(text: Column, normalize: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, SPACE_RUN, " ") if normalize else text


def _bit_table(pairs: DataFrame, bits: int) -> DataFrame:
    """One row: an array of 2**(bits-6) longs with the pairs' bits set. Its size is fixed by `bits`."""
    at = _slot(bits)
    words = pairs.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast({_SLOT.format(mask=63)} as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = pairs.sparkSession.range(1 << bits - 6).withColumnRenamed("id", "word").join(words, "word", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))["bits"].alias("bits"))


_SLOT = "xxhash64(length, prefix) & {mask}L"


def _slot(bits: int) -> Column:
    return F.expr(_SLOT.format(mask=(1 << bits) - 1))


def exact_dedup(documents: DataFrame, *, id: str = "doc_id", text: str = "text", prefix: int = 64, bits: int = 20, normalize: bool = True, digest: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, sha256 (null for texts that had no rival, unless `digest`)."""
    whole = documents.select(F.col(id).alias("id"), normalized(F.col(text), normalize).alias("norm"))
    keyed = whole.select("id", "norm", F.octet_length("norm").alias("length"), F.xxhash64(F.substring("norm", 1, prefix)).alias("prefix"))

    small = stored(keyed.select("length", "prefix"), "exact-lengths")
    by_length = small.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("length")
    # counted before the join, so that a hot length brings one row for each prefix and task
    by_prefix = small.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).join(by_length, "length", "left_semi").where("n > 1")
    table = stored(_bit_table(by_prefix.select("length", "prefix"), bits), "exact-bits")

    at = _slot(bits)
    rival = F.expr("getbit({0}, cast({1} as int))".format("word", _SLOT.format(mask=63))) == 1
    probed = keyed.withColumn("word", F.get(table.select("bits").scalar(), F.shiftright(at, 6).cast("int"))).withColumn("rival", rival)
    full = F.sha2("norm", 256)
    rows = stored(probed.select(F.monotonically_increasing_id().alias("row"), "id", "length", "rival", (full if digest else F.when(F.col("rival"), full)).alias("sha256")), "exact-hashes")

    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row")))
    # stored, so that the join's two sides are plain shuffles and Spark can split a hot group of copies
    groups = stored(rows.where("rival").groupBy("length", "sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "exact-groups")
    found = rows.where("rival").join(groups, ["length", "sha256"], "left").select(
        "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"), "sha256")
    alone = rows.where("not rival").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha256")
    return alone.unionByName(found)
