"""Cost features of a work against its category, state, constituency and sponsor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions.ranks import with_percentile_rank
from worklens.functions.scalars import exact_avg, ratio
from worklens.operators.cohorts import by_group, spread, z_score
from worklens.params import Params
from worklens.plans.baselines import RANK, with_cohort
from worklens.plans.clean import per_sponsor
from worklens.sources.staging import attach, settle

FINANCIAL_COLUMNS = [
    "work_id", "project_status", "state", "constituency", "category", "effective_amount", "recommended_amount",
    "final_amount", "expenditure_ratio", "unspent_balance", "recommendation_sanction_ratio",
    "expenditure_deviation", "cost_deviation", "cost_percentile", "state_cost_percentile",
    "constituency_cost_percentile", "release_ratio",
]
RANKED_BY = ["category", "state", "constituency", "effective_amount"]


def with_effective_amount(works: DataFrame) -> DataFrame:
    return works.withColumn("effective_amount", F.coalesce("final_amount", "recommended_amount"))


def with_release_ratio(works: DataFrame, sponsors: DataFrame) -> DataFrame:
    lookup = per_sponsor(sponsors, ["total_expenditure", "allocated_amount"]).select(
        "mp_name", "constituency", ratio(F.col("total_expenditure"), F.col("allocated_amount")).alias("release_ratio")
    )
    return attach(works, lookup, ["mp_name", "constituency"], "release")


def cost_ranks(source: DataFrame, p: Params = Params(), sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The three cost percentiles per distinct (category, state, constituency, amount), and the one in the cohort if cohort sizes are given.

    This slim table with its counts is what is ranked, one grouping after the other, so the wide rows are shuffled once, for the join back.
    """
    slim = source.where(F.col("effective_amount").isNotNull()).groupBy(*RANKED_BY).agg(F.count(F.lit(1)).alias("_rows"))
    slim = settle(slim, "cost-places")
    ranked = ["cost_percentile", "state_cost_percentile", "constituency_cost_percentile"]
    df = slim
    for key, out in zip(["category", "state", "constituency"], ranked):
        df = with_percentile_rank(df, key, "effective_amount", "_rows", out, p.min_group)
    if sizes is not None:
        df = with_percentile_rank(with_cohort(df, p, sizes), "baseline_group", "effective_amount", "_rows", RANK)
        ranked.append(RANK)
    return df.select(*RANKED_BY, *ranked)


def with_cost_ranks(
    df: DataFrame, source: DataFrame, p: Params = Params(), sizes: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    ranks = settle(cost_ranks(source, p, sizes), "cost-ranks")
    same = None
    for name in RANKED_BY:
        ranks = ranks.withColumnRenamed(name, f"_{name}")
        match = F.col(name).eqNullSafe(F.col(f"_{name}"))
        same = match if same is None else same & match
    return df.join(ranks, same, "left").drop(*[f"_{name}" for name in RANKED_BY])


def with_financial(
    works: DataFrame, sponsors: DataFrame, p: Params = Params(), source: DataFrame | None = None,
    sizes: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """All cost features as added columns; one statistics pass per grouping column.

    Group statistics are taken from ``source``, the plain works, so that no earlier join is repeated for them. With the sizes of
    the cohorts, the rank in the cohort is added as well.
    """
    df = with_effective_amount(works).withColumns(
        {
            "expenditure_ratio": ratio(F.col("final_amount"), F.col("recommended_amount")),
            "unspent_balance": F.col("recommended_amount") - F.col("final_amount"),
        }
    )
    base = with_effective_amount(works if source is None else source)
    by_state = by_group(
        base, "state", *spread("effective_amount", "cost"), exact_avg(F.col("recommended_amount")).alias("_rec_mean")
    )
    by_category = by_group(base, "category", *spread("final_amount", "exp"))
    df = attach(attach(df, by_state, ["state"], "state-cost"), by_category, ["category"], "category-cost")
    df = df.withColumns(
        {
            "recommendation_sanction_ratio": ratio(F.col("recommended_amount"), F.col("_rec_mean")),
            "expenditure_deviation": z_score("final_amount", "exp", p),
            "cost_deviation": z_score("effective_amount", "cost", p),
        }
    )
    df = with_cost_ranks(df.drop("_cost_n", "_cost_mean", "_cost_std", "_rec_mean", "_exp_n", "_exp_mean", "_exp_std"), base, p, sizes)
    return with_release_ratio(df, sponsors)


def financial_features(works: DataFrame, sponsors: DataFrame, p: Params = Params()) -> DataFrame:
    return with_financial(works, sponsors, p).select(*FINANCIAL_COLUMNS)
