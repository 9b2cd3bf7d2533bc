"""Human review log: validated append, latest state per work, status on the result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.functions.ranks import row_numbers
from worklens.functions.scalars import rounded
from worklens.plans.master import NOT_REVIEWED

# The allowed statuses and the default reviewer.
STATUSES = [
    "Not Reviewed",
    "Verified Normal",
    "Needs Further Review",
    "Evidence Insufficient",
    "Manual Investigation Required",
]
DEFAULT_REVIEWER = "Auditor Officer"
LOG_SCHEMA = (
    "log_id string, work_id bigint, review_status string, reviewer_notes string, reviewer_id string, "
    "review_timestamp timestamp_ntz, ai_risk_score_at_review double, ai_risk_category_at_review string"
)
LOG_COLUMNS = [part.split()[0] for part in LOG_SCHEMA.split(", ")]


def create_log(spark: SparkSession, name: str) -> None:
    """Empty typed log, if there is none."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({LOG_SCHEMA}) USING parquet")


def is_valid() -> Column:
    return F.coalesce(F.col("review_status").isin(STATUSES), F.lit(False))


def prepared(entries: DataFrame) -> DataFrame:
    """Trimmed notes, default reviewer, score snapshot with two decimals."""
    reviewer = F.trim(F.coalesce("reviewer_id", F.lit("")))
    return entries.withColumns(
        {
            "reviewer_notes": F.trim("reviewer_notes"),
            "reviewer_id": F.when(reviewer == "", DEFAULT_REVIEWER).otherwise(reviewer),
            "ai_risk_score_at_review": rounded(F.col("ai_risk_score_at_review").cast("double"), 2),
        }
    )


def split_valid(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries fit for the log, rejected entries)."""
    return prepared(entries.where(is_valid())), entries.where(~is_valid())


def with_log_ids(entries: DataFrame, already: int, order: list[str]) -> DataFrame:
    """``AUDIT_000001``-style ids that go on after the ``already`` logged entries, in time order.

    Places come from ranges of the order, so any number of entries may share a minute or an instant, or have no time.
    """
    placed = row_numbers(entries, order, "_k")
    return placed.withColumn("log_id", F.format_string("AUDIT_%06d", F.lit(already + 1) + F.col("_k"))).drop("_k")


def append_reviews(entries: DataFrame, log: str, rejected: str) -> None:
    """Append valid entries to the log table and the others to the rejection table."""
    good, bad = split_valid(entries)
    good.select(*LOG_COLUMNS).write.mode("append").saveAsTable(log)
    bad.select(*LOG_COLUMNS).write.mode("append").saveAsTable(rejected)


def latest_reviews(log: DataFrame, strict: bool = False) -> DataFrame:
    """State per work. By default each column shows its latest non-null value; ``strict`` takes the latest row.

    Both are aggregates with map-side combine, so a work with very many entries is no hot spot.
    """
    rest = [c for c in log.columns if c not in ("work_id", "review_timestamp")]
    when = F.struct("review_timestamp", "log_id")
    if strict:
        last = F.max_by(F.struct("review_timestamp", *rest), when).alias("_last")
        return log.groupBy("work_id").agg(last).select("work_id", "_last.*")
    values = [F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in rest]
    return log.groupBy("work_id").agg(F.max("review_timestamp").alias("review_timestamp"), *values)


def with_verification_status(master: DataFrame, log: DataFrame) -> DataFrame:
    status = latest_reviews(log).select("work_id", F.col("review_status").alias("_status"))
    joined = master.drop("verification_status").join(status, "work_id", "left")
    return joined.withColumn("verification_status", F.coalesce("_status", F.lit(NOT_REVIEWED))).drop("_status")


def history(log: DataFrame, work_id: int | None = None) -> DataFrame:
    """Newest first, optionally of one work."""
    rows = log if work_id is None else log.where(F.col("work_id") == work_id)
    return rows.orderBy(F.desc("review_timestamp"), F.desc("log_id"))
