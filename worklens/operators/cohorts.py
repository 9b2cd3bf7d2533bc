"""Statistics of groups joined back to rows: means, z-scores, percentile ranks, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.ranks import MONEY, Bucket, percentile_ranks
from worklens.functions.scalars import exact_avg, ratio
from worklens.params import Params
from worklens.sources.staging import attach


def spread(value: str | Column, name: str) -> list[Column]:
    """Count, mean and sample deviation of a money column, as aggregates."""
    value = F.col(value) if isinstance(value, str) else value
    return [
        F.count(value).alias(f"_{name}_n"),
        exact_avg(value).alias(f"_{name}_mean"),
        F.stddev_samp(value).alias(f"_{name}_std"),
    ]


def z_score(value: str, name: str, p: Params = Params()) -> Column:
    """Z-score from ``spread`` columns; null in small or flat groups."""
    mean, std = F.col(f"_{name}_mean"), F.col(f"_{name}_std")
    fits = (F.col(f"_{name}_n") >= p.min_group) & (std > p.flat_std)
    return F.when(fits, (F.col(value) - mean) / std)


def by_group(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)


def with_z_score(df: DataFrame, key: str, value: str, out: str, p: Params = Params()) -> DataFrame:
    stats = by_group(df, key, *spread(value, "z"))
    return attach(df, stats, [key], "zscore").withColumn(out, z_score(value, "z", p)).drop("_z_n", "_z_mean", "_z_std")


def with_percentile(df: DataFrame, key: str, value: str, out: str, min_size: int, bucket: Bucket = MONEY) -> DataFrame:
    """Percentile rank inside the group, joined back on (group, value)."""
    return df.join(percentile_ranks(df, [key], value, out, min_size, bucket), [key, value], "left")


def with_ratio_to_mean(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    stats = by_group(df, key, exact_avg(F.col(value)).alias("_mean"))
    return attach(df, stats, [key], "mean").withColumn(out, ratio(F.col(value), F.col("_mean"))).drop("_mean")


def with_group_size(df: DataFrame, key: str, counted: str, out: str) -> DataFrame:
    """Size of the row's group. Only rows with a value count and only they get a size."""
    stats = by_group(df, key, F.count(counted).alias(out))
    return attach(df, stats, [key], "size").withColumn(out, F.when(F.col(counted).isNotNull(), F.col(out)))


def with_group_total(df: DataFrame, key: str, amount: Column, out: str) -> DataFrame:
    return attach(df, by_group(df, key, amount.alias(out)), [key], "total")


def with_min_max_scaled(df: DataFrame, value: str, out: str, places: int = 6) -> DataFrame:
    """Value scaled to 0-1 over all rows; bounds come from one aggregate, not from a window."""
    from worklens.functions.scalars import rounded

    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    scaled = F.try_divide(F.col(value) - F.lit(low), F.lit(high) - F.lit(low))
    return df.withColumn(out, rounded(scaled, places))
