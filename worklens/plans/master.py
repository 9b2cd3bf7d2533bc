"""The integrated result table: one row per work, 41 columns, defaults filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.scalars import rounded
from worklens.params import Params

NOT_REVIEWED = "Not Reviewed"


def _or(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def master_table(scored: DataFrame, p: Params = Params()) -> DataFrame:
    c = F.col
    return scored.select(
        "work_id",
        _or("mp_name", "Unspecified MP").alias("mp_name"),
        "project_status",
        "state",
        "constituency",
        _or("category", "Normal/Others").alias("category"),
        _or("work_description", "No description provided").alias("work_description"),
        _or("recommended_amount", 0.0).alias("recommended_amount"),
        _or("final_amount", 0.0).alias("sanctioned_amount"),
        _or("effective_amount", 0.0).alias("effective_amount"),
        _or("allocated_amount", 0.0).alias("mp_allocated_amount"),
        _or("total_expenditure", 0.0).alias("mp_total_expenditure"),
        _or("utilization_pct", 0.0).alias("mp_utilization_pct"),
        _or("completed_works_count", 0).cast("bigint").alias("mp_completed_works"),
        _or("recommended_works_count", 0).cast("bigint").alias("mp_recommended_works"),
        _or("completion_rate_pct", 0.0).alias("mp_completion_rate_pct"),
        _or("recommendation_date", "N/A").alias("recommendation_date"),
        F.lit("N/A").alias("sanction_date"),
        _or("completed_date", "N/A").alias("completion_date"),
        _or("project_duration_days", 0).alias("duration_days"),
        _or("recommendation_year", p.default_year).alias("recommendation_year"),
        _or("is_impossible_date_sequence", 0).alias("is_impossible_date_sequence"),
        _or("constituency_max_vendor_share", 0.0).alias("constituency_max_vendor_share"),
        _or("constituency_pending_payment_ratio", 0.0).alias("constituency_pending_payment_ratio"),
        rounded(c("isolation_forest_score"), 2).alias("isolation_forest_score"),
        "baseline_group",
        rounded(c("group_mean"), 2).alias("group_mean"),
        rounded(c("group_median"), 2).alias("group_median"),
        rounded(c("group_p99"), 2).alias("group_p99"),
        rounded(c("z_score"), 2).alias("cost_z_score"),
        rounded(c("percentile"), 1).alias("percentile"),
        c("statistical_flag").alias("statistical_flags"),
        rounded(c("nearest_similarity_score"), 4).alias("nearest_similarity_score"),
        c("similar_project_count").cast("int").alias("similar_project_count"),
        rounded(c("financial_score"), 2).alias("financial_score"),
        rounded(c("temporal_score"), 2).alias("temporal_score"),
        rounded(c("vendor_score"), 2).alias("vendor_score"),
        "final_risk_score",
        "risk_category",
        "explanation",
        F.lit(NOT_REVIEWED).alias("verification_status"),
    )
