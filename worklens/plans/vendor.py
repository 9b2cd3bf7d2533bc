"""Vendor roll-up of payments and its cohort view per constituency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.ranks import group_quantiles
from worklens.functions.scalars import place_key, ratio
from worklens.params import Params
from worklens.plans.temporal import percent_change
from worklens.sources.staging import attach, settle

SUCCESS = "Payment Success"
VENDOR_COLUMNS = [
    "vendor", "state", "constituency", "mp_name", "ida", "transaction_count", "total_vendor_expenditure",
    "average_vendor_transaction", "median_vendor_transaction", "vendor_repeat_rate", "pending_payment_ratio",
    "payment_status_distribution", "vendor_share_of_constituency_expenditure", "vendor_share_of_MP_expenditure",
    "transaction_frequency", "year_over_year_vendor_change",
]


def _paid() -> Column:
    return F.coalesce(F.col("payment_status") == SUCCESS, F.lit(False))


def spend_parts(payments: DataFrame, p: Params = Params()) -> DataFrame:
    """One scan of the payments: everything that adds up, per (vendor, constituency, sponsor).

    Totals, shares and year sums are built from this much smaller table.
    """
    amount = F.col("expenditure_amount").cast("decimal(18,2)")
    early, late = p.payment_years
    year = F.col("expenditure_year")
    return payments.groupBy("vendor", "constituency", "mp_name").agg(
        F.count("expenditure_amount").alias("n"),
        F.sum(amount).alias("amount"),
        F.count_if(~_paid()).alias("pending"),
        F.count_if(_paid()).alias("success"),
        F.sum(F.when(year == early, amount)).alias("early"),
        F.sum(F.when(year == late, amount)).alias("late"),
        F.count_if(year == early).alias("early_rows"),
        F.count_if(year == late).alias("late_rows"),
    )


def vendor_totals(payments: DataFrame) -> DataFrame:
    return totals_of(spend_parts(payments))


def totals_of(parts: DataFrame) -> DataFrame:
    total = F.sum("amount").cast("double")
    return (
        parts.where(F.col("vendor").isNotNull())
        .groupBy("vendor")
        .agg(
            F.sum("n").alias("transaction_count"),
            total.alias("total_vendor_expenditure"),
            F.try_divide(total, F.sum("n").cast("double")).alias("average_vendor_transaction"),
            F.sum("pending").alias("pending_count"),
            F.sum("success").alias("success_count"),
        )
    )


def with_vendor_ratios(totals: DataFrame) -> DataFrame:
    n = F.col("transaction_count")
    return totals.withColumns(
        {
            "vendor_repeat_rate": ratio(n - 1, n),
            "pending_payment_ratio": ratio(F.col("pending_count"), n),
            "payment_status_distribution": ratio(F.col("success_count"), n),
        }
    )


def largest_share(payments: DataFrame, of: str, out: str, amount: str = "expenditure_amount") -> DataFrame:
    """Per vendor, its largest share of any ``of`` value's spend. Both sums start from (vendor, of) totals."""
    spent = F.sum(F.col(amount).cast("decimal(28,2)"))
    known = payments.where(F.col(of).isNotNull())
    parts = known.where(F.col("vendor").isNotNull()).groupBy("vendor", of).agg(spent.alias("_part"))
    whole = known.groupBy(of).agg(spent.alias("_whole"))
    return parts.join(whole, of).groupBy("vendor").agg(F.max(ratio(F.col("_part"), F.col("_whole"))).alias(out))


def active_months(payments: DataFrame) -> DataFrame:
    month = F.trunc(F.to_date("expenditure_date_iso"), "month")
    rows = payments.where(F.col("vendor").isNotNull()).select("vendor", month.alias("_month")).distinct()
    return rows.groupBy("vendor").agg(F.count("_month").alias("active_months_count"))


FIRST_COLUMNS = ["state", "constituency", "mp_name", "ida"]


def first_seen(payments: DataFrame, extra: list[str] = FIRST_COLUMNS) -> DataFrame:
    """First record per vendor by date, amount and the remaining columns.

    The first day comes from a hash aggregate over a plain date; whole records are compared on that day only.
    """
    day = F.coalesce(F.to_date("expenditure_date_iso"), F.to_date(F.lit("0001-01-01")))
    rows = payments.where(F.col("vendor").isNotNull()).withColumn("_day", day)
    days = rows.groupBy("vendor").agg(F.min("_day").alias("_day"))
    order = F.struct("expenditure_amount", *extra, "work_description", "payment_status")
    first = rows.join(settle(days, "first-days"), ["vendor", "_day"]).groupBy("vendor").agg(F.min(order).alias("_first"))
    return first.select("vendor", *[F.col(f"_first.{c}").alias(c) for c in extra])


def _change_of(parts: DataFrame, out: str) -> DataFrame:
    zero = F.lit(0).cast("decimal(38,2)")
    early = F.coalesce(F.sum("early"), zero).cast("double")
    late = F.coalesce(F.sum("late"), zero).cast("double")
    both = parts.agg((F.sum("early_rows") > 0) & (F.sum("late_rows") > 0)).scalar()
    sums = parts.groupBy("vendor").agg(early.alias("_early"), late.alias("_late"))
    return sums.select("vendor", F.when(both, percent_change(F.col("_early"), F.col("_late"))).alias(out))


def vendor_features(payments: DataFrame, p: Params = Params()) -> DataFrame:
    vendors = payments.where(F.col("vendor").isNotNull())
    parts = settle(spend_parts(payments, p), "spend-parts")
    named = parts.where(F.col("vendor").isNotNull())
    df = with_vendor_ratios(totals_of(parts))
    for part in (
        group_quantiles(vendors, ["vendor"], "expenditure_amount", {"median_vendor_transaction": 0.5}),
        largest_share(parts, "constituency", "vendor_share_of_constituency_expenditure", "amount"),
        largest_share(parts, "mp_name", "vendor_share_of_MP_expenditure", "amount"),
        active_months(payments),
        _change_of(named, "year_over_year_vendor_change"),
        first_seen(payments),
    ):
        df = df.join(part, "vendor", "left")
    frequency = ratio(F.col("transaction_count"), F.col("active_months_count"))
    return df.withColumn("transaction_frequency", frequency).select(*VENDOR_COLUMNS)


def cohort_inputs(payments: DataFrame) -> DataFrame:
    """Per vendor what ``vendor_cohorts`` reads, equal to those columns of ``vendor_features``.

    Sums per (vendor, constituency) are the only exchange of many rows: totals and largest shares follow from them.
    """
    amount = F.col("expenditure_amount").cast("decimal(18,2)")
    spent = F.sum(amount)
    whole = payments.where(F.col("constituency").isNotNull()).groupBy("constituency").agg(spent.alias("_whole"))
    parts = payments.where(F.col("vendor").isNotNull()).groupBy("vendor", "constituency").agg(
        F.count("expenditure_amount").alias("n"), spent.alias("_part"), F.count_if(~_paid()).alias("pending"), F.count_if(_paid()).alias("success")
    )
    total = F.sum("_part").cast("double")
    totals = attach(parts, whole, ["constituency"], "constituency-spend").groupBy("vendor").agg(
        F.sum("n").alias("transaction_count"),
        F.try_divide(total, F.sum("n").cast("double")).alias("average_vendor_transaction"),
        F.sum("pending").alias("pending_count"),
        F.sum("success").alias("success_count"),
        F.max(ratio(F.col("_part"), F.col("_whole"))).alias("vendor_share_of_constituency_expenditure"),
    )
    return with_vendor_ratios(totals).join(first_seen(payments), "vendor", "left")


COHORT_METRICS = [
    "constituency_max_vendor_share", "constituency_avg_vendor_transaction", "constituency_vendor_count",
    "constituency_avg_vendor_repeat_rate", "constituency_pending_payment_ratio",
]


def vendor_cohorts(vendors: DataFrame) -> DataFrame:
    """Per normalised (state, constituency): concentration, size and payment habits of its vendors."""
    return (
        vendors.groupBy(
            place_key(F.col("state")).alias("clean_state"), place_key(F.col("constituency")).alias("clean_const")
        )
        .agg(
            F.max("vendor_share_of_constituency_expenditure").alias("constituency_max_vendor_share"),
            F.avg("average_vendor_transaction").alias("constituency_avg_vendor_transaction"),
            F.count_distinct("vendor").alias("constituency_vendor_count"),
            F.avg("vendor_repeat_rate").alias("constituency_avg_vendor_repeat_rate"),
            F.avg("pending_payment_ratio").alias("constituency_pending_payment_ratio"),
        )
    )


def with_vendor_cohort(works: DataFrame, vendors: DataFrame) -> DataFrame:
    df = works.withColumns(
        {"clean_state": place_key(F.col("state")), "clean_const": place_key(F.col("constituency"))}
    )
    return attach(df, vendor_cohorts(vendors), ["clean_state", "clean_const"], "vendor-cohort").drop(
        "clean_state", "clean_const"
    )


def spend_rows(payments: DataFrame) -> DataFrame:
    """The columns of ``spend_parts`` that totals and shares read, a row per payment."""
    return payments.select(
        "vendor", "constituency", "mp_name", F.col("expenditure_amount").cast("decimal(18,2)").alias("amount"),
        F.col("expenditure_amount").isNotNull().cast("int").alias("n"), (~_paid()).cast("int").alias("pending"), _paid().cast("int").alias("success"),
    )


def vendor_concentration(payments: DataFrame, p: Params = Params()) -> DataFrame:
    """Vendors with their totals, ratios and largest shares, from one scan of the payments.

    Few payments share vendor, constituency and sponsor, so they are settled as they are: sums of all three would be an exchange more.
    """
    parts = settle(spend_rows(payments), "spend-rows")
    df = with_vendor_ratios(totals_of(parts))
    df = df.join(largest_share(parts, "constituency", "max_constituency_share", "amount"), "vendor", "left")
    return df.join(largest_share(parts, "mp_name", "max_sponsor_share", "amount"), "vendor", "left")
