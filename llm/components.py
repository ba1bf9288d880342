"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.storage import stored


def _stamp(edges: DataFrame) -> tuple:
    # sum of hashes as decimal: exact, and independent of order
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return near.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b) but the smallest of each component.

    Rounds grow with the logarithm of the longest path; no component or list of
    neighbours is ever gathered in one task or on the driver. An id that is not
    in the result is its own component. No edges give no rows.
    """
    now = stored(edges.where("a <> b").distinct(), "edges")
    before = None
    while (stamp := _stamp(now)) != before:
        before = stamp
        now = stored(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
