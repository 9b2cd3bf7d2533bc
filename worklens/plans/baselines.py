"""Peer-cohort benchmarks: hierarchical cohort choice, benchmark table, z-score, percentile, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions.ranks import group_quantiles, percentile_ranks
from worklens.functions.scalars import exact_avg, flag, rounded
from worklens.operators.cohorts import by_group
from worklens.params import Params
from worklens.sources.staging import attach, settle

BASELINE_COLUMNS = [
    "work_id", "project_status", "state", "constituency", "category", "effective_amount", "baseline_group",
    "baseline_type", "group_mean", "group_std", "group_median", "group_p75", "group_p90", "group_p95", "group_p99",
    "z_score", "percentile", "statistical_flag", "z_flag", "p95_flag", "p99_flag",
]
#: A work's percentile rank in its cohort.
RANK = "_rank"
POINTS = {"group_median": 0.5, "group_p75": 0.75, "group_p90": 0.90, "group_p95": 0.95, "group_p99": 0.99}


def cohort_sizes(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works per category and per constituency, settled. Sizes are rows, not amounts."""
    per_category = by_group(works, "category", F.count(F.lit(1)).alias("_n_category"))
    per_constituency = by_group(works, "constituency", F.count(F.lit(1)).alias("_n_constituency"))
    return settle(per_category, "category-size"), settle(per_constituency, "constituency-size")


def with_cohort(works: DataFrame, p: Params = Params(), sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Category if it has enough works, else constituency, else state."""
    per_category, per_constituency = sizes or cohort_sizes(works)
    df = works.join(per_category, ["category"], "left").join(per_constituency, ["constituency"], "left")
    kind = (
        F.when(F.col("_n_category") >= p.min_group, "Category")
        .when(F.col("_n_constituency") >= p.min_group, "Constituency")
        .otherwise("State")
    )
    name = (
        F.when(F.col("baseline_type") == "Category", F.col("category"))
        .when(F.col("baseline_type") == "Constituency", F.col("constituency"))
        .otherwise(F.coalesce("state", F.lit("nan")))
    )
    return (
        df.withColumn("baseline_type", kind)
        .withColumn("baseline_group", F.concat("baseline_type", F.lit(": "), name))
        .drop("_n_category", "_n_constituency")
    )


def cohort_benchmarks(grouped: DataFrame) -> DataFrame:
    """Mean, deviation and exact quantiles per cohort, one row each."""
    amount = F.col("effective_amount")
    basic = grouped.groupBy("baseline_group").agg(
        F.count(F.lit(1)).alias("group_rows"),
        exact_avg(amount).alias("group_mean"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("group_std"),
    )
    return basic.join(group_quantiles(grouped, ["baseline_group"], amount, POINTS), "baseline_group", "left")


def with_baseline(
    works: DataFrame, p: Params = Params(), source: DataFrame | None = None, sizes: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Works (with ``effective_amount``) plus cohort, benchmarks, z-score, percentile and flags.

    Benchmarks are taken from ``source``, the plain works, so that no earlier join is repeated for them. Works that bring their
    rank in the cohort along (``RANK``) aren't shuffled for it again.
    """
    source = works if source is None else source
    sizes = sizes or cohort_sizes(source)
    df = with_cohort(works, p, sizes)
    grouped = settle(with_cohort(source, p, sizes).select("baseline_group", "effective_amount"), "cohort-amounts")
    df = attach(df, cohort_benchmarks(grouped), ["baseline_group"], "benchmarks")
    if RANK in works.columns:
        ahead = ["baseline_group", "effective_amount"]  # where the other join puts them: rows are fingerprinted by column order
        df = df.select(*ahead, *[c for c in df.columns if c not in ahead])
    else:
        ranks = percentile_ranks(grouped, ["baseline_group"], "effective_amount", RANK)
        df = attach(df, ranks, ["baseline_group", "effective_amount"], "cohort-ranks")
    z = F.try_divide(F.col("effective_amount") - F.col("group_mean"), F.nullif(F.col("group_std"), F.lit(0.0)))
    df = df.withColumns(
        {
            "z_score": rounded(F.coalesce(z, F.lit(0.0)), 4),
            "percentile": F.when(F.col("group_rows") <= 1, 50.0).otherwise(rounded(F.col(RANK), 4)),
        }
    ).drop(RANK, "group_rows")
    df = df.withColumns(
        {
            "z_flag": flag(F.col("z_score") > p.z_cut),
            "p95_flag": flag(F.col("percentile") >= p.upper_pct),
            "p99_flag": flag(F.col("percentile") >= p.extreme_pct),
        }
    )
    return df.withColumn("statistical_flag", F.greatest("z_flag", "p95_flag"))



def cohort_summary(scored: DataFrame, top: int = 15) -> DataFrame:
    """Largest cohorts with their benchmarks."""
    return (
        scored.groupBy("baseline_group")
        .agg(
            F.count("work_id").alias("project_count"),
            F.max("group_median").alias("median_expenditure"),
            F.max("group_mean").alias("mean_expenditure"),
            F.max("group_p99").alias("p99_ceiling"),
        )
        .orderBy(F.desc("project_count"), "baseline_group")
        .limit(top)
    )


