"""Raw records to canonical tables: rename, parse, drop exact copies, unify works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions.scalars import in_years, iso_date, iso_text, money, recode
from worklens.params import Params

# Column titles of the published source files and their canonical names.
PAYMENT_TITLES = {
    "MP Name": "mp_name",
    "Constituency": "constituency",
    "State": "state",
    "Work Description": "work_description",
    "Vendor": "vendor",
    "IDA": "ida",
    "Expenditure Amount (₹)": "expenditure_amount",
    "Expenditure Date": "expenditure_date",
    "Payment Status": "payment_status",
}
RECOMMENDED_TITLES = {
    "Work ID": "work_id",
    "Work Description": "work_description",
    "MP Name": "mp_name",
    "Constituency": "constituency",
    "State": "state",
    "Recommended Amount (₹)": "recommended_amount",
    "Recommendation Date": "recommendation_date",
    "Has Images": "has_images",
    "IDA": "ida",
}
COMPLETED_TITLES = {
    "Work ID": "work_id",
    "Work Description": "work_description",
    "Category": "category",
    "MP Name": "mp_name",
    "Constituency": "constituency",
    "State": "state",
    "Final Amount (₹)": "final_amount",
    "Completed Date": "completed_date",
    "Has Images": "has_images",
    "Average Rating": "average_rating",
    "IDA": "ida",
}
SPONSOR_TITLES = {
    "MP Name": "mp_name",
    "Constituency": "constituency",
    "State": "state",
    "Allocated Amount (₹)": "allocated_amount",
    "Total Expenditure (₹)": "total_expenditure",
    "Utilization %": "utilization_pct",
    "Completed Works": "completed_works_count",
    "Recommended Works": "recommended_works_count",
    "Completion Rate %": "completion_rate_pct",
    "Unspent Amount (₹)": "unspent_amount",
    "Transaction Count": "transaction_count",
    "Successful Payments": "successful_payments",
    "Pending Payments": "pending_payments",
}
STATUS_OF_SIDES = {"left": "Recommended", "right": "Completed", "both": "Recommended & Completed"}

WORK_COLUMNS = [
    "work_id", "project_status", "work_description", "category", "mp_name", "constituency", "state", "ida",
    "recommended_amount", "final_amount", "recommendation_date", "completed_date", "recommendation_year",
    "completed_year", "has_images", "average_rating", "is_covid_era",
]
SHARED = ["work_description", "mp_name", "constituency", "state", "ida", "has_images"]


def canonical(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(titles)


def clean_payments(raw: DataFrame, p: Params = Params()) -> DataFrame:
    """Exact copies go first, on the raw values, as an aggregate with map-side combine."""
    day = iso_date(F.col("expenditure_date"))
    return (
        canonical(raw, PAYMENT_TITLES)
        .distinct()
        .withColumn("expenditure_amount", money(F.col("expenditure_amount")))
        .withColumn("expenditure_date_iso", iso_text(day))
        .withColumn("expenditure_year", F.year(day))
        .withColumn("is_covid_era", in_years(F.col("expenditure_year"), p.covid_years))
    )


def clean_recommended(raw: DataFrame) -> DataFrame:
    day = iso_date(F.col("recommendation_date"))
    return (
        canonical(raw, RECOMMENDED_TITLES)
        .withColumn("recommended_amount", money(F.col("recommended_amount")))
        .withColumn("recommendation_year", F.year(day))
        .withColumn("recommendation_date", iso_text(day))
    )


def clean_completed(raw: DataFrame) -> DataFrame:
    day = iso_date(F.col("completed_date"))
    return (
        canonical(raw, COMPLETED_TITLES)
        .withColumn("final_amount", money(F.col("final_amount")))
        .withColumn("completed_year", F.year(day))
        .withColumn("completed_date", iso_text(day))
    )


def unify_works(recommended: DataFrame, completed: DataFrame, p: Params = Params()) -> DataFrame:
    """Full outer join on work id, written as left join plus the unmatched completed works.

    Both halves can be split at a hot id by adaptive skew handling; a full outer join can not.
    """
    rec = recommended.select(
        "work_id", "recommended_amount", "recommendation_date", "recommendation_year",
        *[F.col(c).alias(f"{c}_rec") for c in SHARED],
    )
    comp = completed.select(
        "work_id", "category", "final_amount", "completed_date", "completed_year", "average_rating",
        *[F.col(c).alias(f"{c}_comp") for c in SHARED],
    )
    matched = rec.join(comp.withColumn("_in_comp", F.lit(True)), "work_id", "left").withColumn(
        "_side", F.when(F.col("_in_comp"), "both").otherwise("left")
    )
    alone = comp.join(rec.select("work_id"), "work_id", "left_anti").withColumn("_side", F.lit("right"))
    every = matched.drop("_in_comp").unionByName(alone, allowMissingColumns=True)
    every = every.withColumns({c: F.coalesce(f"{c}_comp", f"{c}_rec") for c in SHARED})
    return (
        every.withColumn("project_status", recode(F.col("_side"), STATUS_OF_SIDES))
        .withColumn("is_covid_era", in_years(F.coalesce("completed_year", "recommendation_year"), p.covid_years))
        .select(*WORK_COLUMNS)
    )


def clean_sponsors(raw: DataFrame) -> DataFrame:
    df = canonical(raw, SPONSOR_TITLES)
    return df.withColumns({c: money(F.col(c)) for c in ("allocated_amount", "total_expenditure", "unspent_amount")})


def per_sponsor(sponsors: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (sponsor, constituency), so that the join back never multiplies works."""
    keys = ["mp_name", "constituency"]
    return sponsors.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])
