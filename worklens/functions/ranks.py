"""Exact ranks, percentiles and quantiles per group that never gather a group in one task.

A group may hold a large part of all rows, so a window over the group is no option. Values are cut
into order-keeping buckets instead: rows are counted per bucket first, the running total over the
few buckets of a group gives each bucket its offset, and only inside one bucket are values ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.sources.staging import settle

Bucket = Callable[[Column], Column]


def log_bucket(scale: float = 1.0, per_octave: int = 64) -> Bucket:
    """About 1 % wide buckets; a value range of 2**60 gives at most a few thousand of them."""

    def of(value: Column) -> Column:
        size = F.floor(F.log2(F.abs(value) * scale + 1.0) * per_octave)
        return F.when(value < 0, -size).otherwise(size)

    return of


def even_bucket(width: float) -> Bucket:
    """Equal-width buckets for values with a known range, such as scores between 0 and 1."""
    return lambda value: F.floor(value / width)


MONEY = log_bucket()
ANY = log_bucket(scale=1e4)


def _offsets(per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_bucket.select(
        *keys,
        "_b",
        (F.sum("_bn").over(upto) - F.col("_bn")).alias("_start"),
        F.col("_bn"),
        F.sum("_bn").over(group).alias("_total"),
    )


def _usable(df: DataFrame, keys: list[str], value: Column, bucket: Bucket) -> DataFrame:
    rows = df.select(*keys, value.cast("double").alias("_v"))
    for name in [*keys, "_v"]:
        rows = rows.where(F.col(name).isNotNull())
    # Stated here so that both uses of the counts have the same filter and share one exchange.
    return rows.withColumn("_b", bucket(F.col("_v"))).where(F.col("_b").isNotNull())


def value_positions(df: DataFrame, keys: list[str], value: str, bucket: Bucket = MONEY) -> DataFrame:
    """One row per (group, distinct value): how many rows lie below, how many equal, group size."""
    counts = _usable(df, keys, F.col(value), bucket).groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn")), keys)
    inside = (
        Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        counts.withColumn("_upto", F.sum("_n").over(inside))
        .join(offsets, [*keys, "_b"])
        .select(
            *keys,
            F.col("_v").alias(value),
            (F.col("_start") + F.col("_upto") - F.col("_n")).alias("below"),
            F.col("_n").alias("same"),
            F.col("_total").alias("size"),
        )
    )


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """The rows with their place in the order, from 0; rows that are equal in it get places of their own.

    Rows are dealt by sampled ranges of the order and a row number, so rows of one instant, or without one, go to many tasks as well.
    A task's rows are numbered on their own, and offsets come from the counts per task.
    """
    dealt = df.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(*order, "_id")
    dealt = settle(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per task
    offsets = counts.select("_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_id")) - 1
    return dealt.withColumn("_place", place).join(offsets, "_part").withColumn(out, F.col("_start") + F.col("_place")).drop("_id", "_part", "_place", "_start")


def mean_rank() -> Column:
    return F.col("below") + (F.col("same") + 1) / 2.0


def percentile_ranks(df: DataFrame, keys: list[str], value: str, out: str, min_size: int = 1, bucket: Bucket = MONEY) -> DataFrame:
    """Per (group, value) the percentile rank with average ties, for groups of ``min_size`` or more."""
    return (
        value_positions(df, keys, value, bucket)
        .where(F.col("size") >= min_size)
        .select(*keys, value, (mean_rank() / F.col("size") * 100.0).alias(out))
    )


def with_percentile_rank(df: DataFrame, key: str, value: str, count: str, out: str, min_size: int = 1, bucket: Bucket = MONEY) -> DataFrame:
    """Rows that each stand for ``count`` equal ones, with their percentile rank (average ties) in the group of ``key``.

    The rows travel once, to the bucket they are ranked in, and take their rank along, so no table of ranks is joined back.
    Groups below ``min_size``, and rows without a key or value, get null.
    """
    at = F.col(value).cast("double")
    rows = df.withColumn("_b", bucket(at))
    known = F.col(key).isNotNull() & F.col("_b").isNotNull() & at.isNotNull()
    offsets = _offsets(rows.where(known).groupBy(key, "_b").agg(F.sum(count).alias("_bn")), [key]).drop("_bn")
    inside = Window.partitionBy(key, "_b").orderBy(at)
    upto = F.sum(count).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum(count).over(inside.rangeBetween(Window.currentRow, Window.currentRow))
    placed = rows.withColumns({"_upto": upto, "same": same}).join(offsets, [key, "_b"], "left")
    placed = placed.withColumn("below", F.col("_start") + F.col("_upto") - F.col("same"))
    rank = F.when(known & (F.col("_total") >= min_size), mean_rank() / F.col("_total") * 100.0)
    return placed.withColumn(out, rank).drop("_b", "_upto", "same", "below", "_start", "_total")


def group_quantiles(df: DataFrame, keys: list[str], value: str | Column, points: Mapping[str, float], bucket: Bucket = MONEY) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Two passes: counts per bucket locate the few buckets that hold the wanted positions, and only the
    rows of those buckets are ordered.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = _usable(df, keys, value, bucket)
    offsets = _offsets(rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bn")), keys)

    spots = [((F.col("_total") - 1) * F.lit(float(p)), name) for name, p in points.items()]
    wanted = None
    for at, _ in spots:
        for end in (F.floor(at), F.ceil(at)):
            hit = (F.col("_start") <= end) & (end < F.col("_start") + F.col("_bn"))
            wanted = hit if wanted is None else wanted | hit
    # Settled, so that its size is known: where groups are few it is broadcast, and no row but those of its buckets travels.
    needed = settle(offsets.where(wanted).select(*keys, "_b", "_start", "_total"), "wanted-buckets")

    inside = (
        Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        rows.join(needed, [*keys, "_b"])
        .groupBy(*keys, "_b", "_v", "_start", "_total")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_end") - F.col("_n"))
    )
    picks, outs = [], []
    for i, (at, name) in enumerate(spots):
        for side, end in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_from") <= end) & (end < F.col("_end"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks).select(*keys, *outs)


def quantiles(df: DataFrame, value: str | Column, points: Mapping[str, float], bucket: Bucket = ANY) -> DataFrame:
    """Exact quantiles of a whole column, as one row."""
    one = df.withColumn("_all", F.lit(1))
    return group_quantiles(one, ["_all"], value, points, bucket).drop("_all")


def share_below(values: DataFrame, asked: DataFrame, keys: list[str], value: str, at: str, out: str, bucket: Bucket = MONEY) -> DataFrame:
    """For each asked (group, ``at``): share (0-100) of the group's rows strictly below ``at``.

    Asked points are ranked together with the rows (they count zero), so no point is compared with
    all rows of its group.
    """
    rows = values.select(*keys, F.col(value).cast("double").alias("_x"), F.lit(1).alias("_w"))
    points = asked.select(*keys, F.col(at).cast("double").alias("_x"), F.lit(0).alias("_w")).distinct()
    both = rows.unionByName(points)
    for name in [*keys, "_x"]:
        both = both.where(F.col(name).isNotNull())
    counts = (
        both.withColumn("_b", bucket(F.col("_x")))
        .groupBy(*keys, "_b", "_x")
        .agg(F.sum("_w").alias("_n"), F.max(F.col("_w") == 0).alias("_asked"))
    )
    offsets = _offsets(counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn")), keys)
    inside = (
        Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        counts.withColumn("_upto", F.sum("_n").over(inside))
        .where("_asked")
        .join(offsets, [*keys, "_b"])
        .select(
            *keys,
            F.col("_x").alias(at),
            F.try_divide(
                (F.col("_start") + F.col("_upto") - F.col("_n")).cast("double"), F.col("_total").cast("double")
            ).alias("_s"),
        )
        .select(*keys, at, (F.col("_s") * 100.0).alias(out))
    )
