"""Filters, search, paging and lookups over a result table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def where_equal(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Equality filters, ANDed; parameters that are None are ignored."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def where_in(df: DataFrame, wanted: Mapping[str, Iterable | None]) -> DataFrame:
    """IN-list filters, ANDed; empty lists are ignored."""
    for column, values in wanted.items():
        values = list(values or [])
        if values:
            df = df.where(F.col(column).isin(values))
    return df


def search(df: DataFrame, term: str | None, columns: Iterable[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns. The term is literal text, no pattern."""
    term = (term or "").strip().lower()
    if not term:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(term), F.lit(False))
    return df.where(hit)


def page(df: DataFrame, by: str, tie: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, best first. Ties are broken by ``tie`` so that pages do not overlap."""
    return df.orderBy(F.desc(by), tie).offset(offset).limit(limit)


def options(df: DataFrame, column: str, within: Mapping[str, Iterable | None] | None = None) -> DataFrame:
    """Sorted distinct values of a column, limited by the parent filters."""
    return where_in(df, within or {}).where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The wanted columns that the table has."""
    return df.select(*[c for c in columns if c in df.columns])


def top_per_group(df: DataFrame, group: str, by: str, tie: str, k: int) -> DataFrame:
    """First k rows per group; Spark trims each task to k rows per group before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def project_explorer(master: DataFrame, *, equal: Mapping[str, object] | None = None, among: Mapping[str, Iterable] | None = None, term: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one-row count of matching works, requested page)."""
    hits = where_in(where_equal(master, equal or {}), among or {})
    hits = search(hits, term, ["work_id", "mp_name", "work_description"])
    return hits.agg(F.count(F.lit(1)).alias("total_records")), page(hits, "final_risk_score", "work_id", limit, offset)


def benchmark_comparison(master: DataFrame, work_ids: Iterable | None = None) -> DataFrame:
    """Value against cohort median, mean and 99th percentile in long form."""
    rows = master if work_ids is None else master.where(F.col("work_id").isin(list(work_ids)))
    return rows.select(
        "work_id",
        "baseline_group",
        F.stack(
            F.lit(4),
            F.lit("Project Value"), F.col("effective_amount"),
            F.lit("Cohort Median (P50)"), F.col("group_median"),
            F.lit("Cohort Mean"), F.col("group_mean"),
            F.lit("Cohort 99th Percentile (P99)"), F.col("group_p99"),
        ).alias("measure", "amount"),
    )
