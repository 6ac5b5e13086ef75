"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import discard, saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of `links` that is not its component's least node.

    Every round hangs each node's larger neighbours, then the node itself and its
    smaller ones, onto the least of them, until nothing moves; the number of
    rounds grows with the logarithm of the longest chain.  A round is two joins of
    the links with one row per node.  A node with very many links is pre-aggregated
    by the minimum and split by the join.  Rounds are written to the shared scratch
    folder, so a lost executor costs one round.
    """
    spark = links.sparkSession
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, path = saved(start, "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join deals both sides out and can split a node with very many links.
        least, least_path = saved(both.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        further, new_path = saved(_small_star(_large_star(both, least)), "links")
        new_mark = _mark(further)
        discard(spark, path)
        discard(spark, least_path)
        now, path = further, new_path
        if new_mark == mark:
            break
        mark = new_mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # Links point from the larger node to a smaller one.
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
