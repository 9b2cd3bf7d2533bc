"""Calendar features: delays, impossible sequences, state volume change, delay deviation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.scalars import flag, in_years
from worklens.operators.cohorts import by_group
from worklens.params import Params
from worklens.sources.staging import attach, settle

TEMPORAL_COLUMNS = [
    "work_id", "project_status", "state", "constituency", "category", "recommendation_year", "recommendation_month",
    "expenditure_year", "expenditure_month", "completion_delay_days", "completion_delay_months",
    "project_duration_days", "project_duration_months", "recommendation_to_start_days",
    "is_impossible_date_sequence", "is_negative_duration", "is_covid_era",
    "duration_deviation_from_historical_baseline", "year_over_year_change",
]


def percent_change(earlier: Column, later: Column) -> Column:
    """Relative change in percent; a base of zero gives null."""
    return F.try_divide((later - earlier).cast("double"), F.nullif(earlier, F.lit(0)).cast("double")) * 100.0


def year_change(df: DataFrame, keys: list[str], year: str, years: tuple[int, int], out: str, amount: Column | None = None) -> DataFrame:
    """Per group, change from the first to the second year; null everywhere if either year is absent.

    The sums are settled, so that the rows are read once for them and for the years seen: as a subquery, the rows' plan would stand
    in the query twice, and Spark can't inline the CTEs that such a pair shares.
    """
    base, later = years
    what = F.lit(1) if amount is None else amount.cast("decimal(18,2)")
    sums = (
        df.where(F.col(year).isNotNull())
        .groupBy(*keys)
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col(year) == y, what)), F.lit(0)).cast("double").alias(f"_{name}")
                for name, y in (("base", base), ("later", later))
            ],
            *[F.count_if(F.col(year) == y).alias(f"_rows_{y}") for y in years],
        )
    )
    sums = settle(sums, "year-sums")
    seen = sums.agg((F.sum(f"_rows_{base}") > 0) & (F.sum(f"_rows_{later}") > 0))
    change = percent_change(F.col("_base"), F.col("_later"))
    return sums.select(*keys, F.when(seen.scalar(), change).alias(out))


def usual_payment_year(payments: DataFrame) -> DataFrame:
    """Median payment year per sponsor and constituency. Years are few, so the built-in median is safe."""
    keys = ["mp_name", "constituency"]
    rows = payments.where(F.col("mp_name").isNotNull() & F.col("constituency").isNotNull())
    return rows.groupBy(*keys).agg(F.median("expenditure_year").alias("expenditure_year"))


def with_calendar(works: DataFrame, p: Params = Params()) -> DataFrame:
    """The features that need no other row."""
    rec, comp = F.to_date("recommendation_date"), F.to_date("completed_date")
    delay = F.datediff(comp, rec)
    return works.withColumns(
        {
            "recommendation_year": F.year(rec),
            "recommendation_month": F.month(rec),
            "expenditure_month": F.lit(None).cast("int"),
            "completion_delay_days": delay,
            "completion_delay_months": delay / p.days_per_month,
            "project_duration_days": delay,
            "project_duration_months": delay / p.days_per_month,
            "recommendation_to_start_days": F.lit(None).cast("int"),
            "is_impossible_date_sequence": flag(comp < rec),
            "is_negative_duration": flag(delay < 0),
            "is_covid_era": in_years(F.coalesce(F.year(rec), F.year(comp)), p.covid_years).cast("int"),
        }
    )


def with_temporal(works: DataFrame, payments: DataFrame, p: Params = Params(), source: DataFrame | None = None) -> DataFrame:
    df = with_calendar(works, p)
    base = with_calendar(works if source is None else source, p)
    valid = F.when(F.col("completion_delay_days") >= 0, F.col("completion_delay_days"))
    by_state = by_group(
        base,
        "state",
        F.count("work_id").alias("_works"),
        F.try_divide(F.sum(valid).cast("double"), F.count(valid).cast("double")).alias("_delay_mean"),
        F.stddev_samp(valid).alias("_delay_std"),
    )
    change = year_change(base, ["state"], "recommendation_year", p.works_years, "year_over_year_change")
    df = attach(df, by_state.join(change, "state", "left"), ["state"], "state-delay")
    fits = (F.col("_works") >= p.min_group) & (F.col("_delay_std") > p.flat_std)
    df = df.withColumn(
        "duration_deviation_from_historical_baseline",
        F.when(fits, (valid - F.col("_delay_mean")) / F.col("_delay_std")),
    ).drop("_works", "_delay_mean", "_delay_std")
    return attach(df, usual_payment_year(payments), ["mp_name", "constituency"], "payment-year")


def temporal_features(works: DataFrame, payments: DataFrame, p: Params = Params()) -> DataFrame:
    return with_temporal(works, payments, p).select(*TEMPORAL_COLUMNS)
