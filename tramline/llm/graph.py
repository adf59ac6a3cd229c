"""Connected components on the cluster, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def _toward_min(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link each node's (larger) neighbours to the smallest node it knows."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger_only else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    linked = both.join(least, F.col("a") == F.col("node"))
    if larger_only:
        return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest id it is connected with.

    Each round is aggregations and joins over edges kept in the shared folder; hot nodes are
    combined before the shuffle and their join is splittable.  The number of rounds grows with
    the logarithm of the longest chain.
    """
    oriented = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = settle(oriented(edges), "edges")
    state = None
    while True:
        big = _toward_min(now, True)
        after = settle(oriented(_toward_min(oriented(big), False)), "edges")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if seen == state or seen[0] == 0:
            break
        state = seen
    pairs = now.groupBy("a").agg(F.min("b").alias("b"))
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
