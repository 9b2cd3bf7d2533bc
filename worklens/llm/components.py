"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.sources.staging import settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with the smallest node v that each linked node u reaches; nodes that are a smallest one have no row.

    ``edges``: links u, v of long ids in either order. Each round is written to the shared stage folder, so lost executors
    repeat one round at most. Joins are by node with at most one row on one side, so a hot node can be split.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = settle(edges, "links")
    seen = _mark(edges)
    while True:
        edges = settle(_small_star(_large_star(edges)), "links")
        now = _mark(edges)
        if now == seen:
            return edges
        seen = now
