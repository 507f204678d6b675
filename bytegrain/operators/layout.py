"""Order of entries, and numbers and running offsets that follow it.

Names and sizes are sorted over all partitions; the row's number is its partition's
first number plus its place there, so no task ever holds the whole list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytegrain.operators.stored import stored


def layout_order(layout: str) -> list:
    """Sort columns. `global_score` orders as `size_desc` does."""
    name = F.encode("logical_name", "UTF-8")
    return [name.asc()] if layout == "lexical" else [F.col("uncompressed_size").desc(), name.asc()]


def numbered(entries: DataFrame, layout: str = "lexical", size: str | None = None) -> DataFrame:
    """logical_name, uncompressed_size, entry_id (from 0); with `size` (a long column) also `before`, its sum over earlier rows."""
    order = layout_order(layout)
    columns = list(dict.fromkeys(["logical_name", "uncompressed_size", *([size] if size else [])]))
    own = F.coalesce(F.col(size), F.lit(0).cast("long")) if size else F.lit(0).cast("long")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(entries.select(*columns).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    rows = rows.withColumn("_part", part)
    # a row for each partition
    sums = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(own).alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(starts), "_part").withColumn("entry_id", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    if size:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_before") + F.coalesce(F.sum(own).over(inside), F.lit(0)))
    return out.select(*columns, "entry_id", *(["before"] if size else []))
