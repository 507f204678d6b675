"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is aggregates with map-side combining and joins on the node. The
aggregates are stored first, so both sides of a join are plain shuffles and Spark
can split a node with very many edges. Nothing is collected; a round's tables are
deleted once the next round's edges are stored. A round turns edges towards the
smallest node around; it ends when no edge changes, after a number of rounds that
grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.llm._shared import Tables


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def _star(edges: DataFrame, tables: Tables) -> DataFrame:
    """edges (a, b) with m, the smallest of a's neighbours and a."""
    least = tables.stored(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-least")
    return edges.join(least, "a")


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """edges (a, b) of one orderable type -> node, component (its smallest node), for each node with an edge to another.

    The result reads one stored table, which `tables` keeps where it is given.
    """
    own = Tables(edges.sparkSession)
    now = own.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = own.stored(_star(both, own).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "components-large")
        small = _star(large, own)
        now = own.stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "components")
        own.drop(keep=1)
    if tables is not None:
        tables.paths += own.paths
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
