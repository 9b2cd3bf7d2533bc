"""The model's feature matrix and its dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions.scalars import rounded
from worklens.operators import quality
from worklens.params import Params
from worklens.plans.financial import with_financial
from worklens.plans.temporal import with_temporal
from worklens.plans.text import with_text
from worklens.plans.vendor import cohort_inputs, with_vendor_cohort

ID_COLUMNS = ["work_id", "project_status", "state", "constituency"]

# The 21 features in model order; the flags marked False carry no signal for the model.
FEATURES = {
    "effective_amount": True,
    "cost_deviation": True,
    "state_cost_percentile": True,
    "constituency_cost_percentile": True,
    "release_ratio": True,
    "recommendation_sanction_ratio": True,
    "is_impossible_date_sequence": True,
    "is_negative_duration": False,
    "is_covid_era": False,
    "year_over_year_change": True,
    "description_length": True,
    "word_count": True,
    "tfidf_mean": True,
    "tfidf_max": True,
    "nearest_similarity_score": True,
    "similar_project_count": True,
    "constituency_max_vendor_share": True,
    "constituency_avg_vendor_transaction": True,
    "constituency_vendor_count": True,
    "constituency_avg_vendor_repeat_rate": True,
    "constituency_pending_payment_ratio": True,
}
# Fills that are no medians.
CONSTANT_FILLS = {
    "recommendation_sanction_ratio": 1.0,
    "year_over_year_change": 0.0,
    "constituency_vendor_count": 0.0,
    "constituency_avg_vendor_repeat_rate": 0.0,
    "constituency_pending_payment_ratio": 0.0,
}
# Per column of the matrix: what it is computed from, how, its type, and what it says. Our own wording throughout.
DICTIONARY = {
    "work_id": ("work_id", "as recorded", "string", "Number of the work"),
    "project_status": ("presence in both lists", "recommended, completed or both", "string", "How far the work has come"),
    "state": ("state", "as recorded", "string", "State of the sponsor"),
    "constituency": ("constituency", "as recorded", "string", "Constituency of the sponsor"),
    "effective_amount": ("final_amount, recommended_amount", "final amount, else recommended amount", "double", "What the work costs"),
    "cost_deviation": ("effective_amount", "z-score within the state", "double", "Deviations above or below the state's usual cost"),
    "state_cost_percentile": ("effective_amount", "percentile rank within the state", "double", "Place among the state's works by cost"),
    "constituency_cost_percentile": ("effective_amount", "percentile rank within the constituency", "double", "Place among the constituency's works by cost"),
    "release_ratio": ("total_expenditure, allocated_amount", "spent over allocated", "double", "Share of the sponsor's allocation that is spent"),
    "recommendation_sanction_ratio": ("recommended_amount", "amount over the state's mean", "double", "Size against the state's usual recommendation"),
    "is_impossible_date_sequence": ("completed_date, recommendation_date", "completed before recommended", "int", "Dates that can't both be right"),
    "is_negative_duration": ("completed_date, recommendation_date", "days between below zero", "int", "Duration below zero"),
    "is_covid_era": ("recommendation_year, completed_year", "year among the listed ones", "int", "Falls into the years of the pandemic"),
    "year_over_year_change": ("works per state and year", "percent change to the year before", "double", "Growth of the state's number of works"),
    "description_length": ("work_description", "number of characters", "int", "Length of the description"),
    "word_count": ("work_description", "number of words", "int", "Words of the description"),
    "tfidf_mean": ("work_description", "mean term weight over the vocabulary", "double", "How much the description says on average"),
    "tfidf_max": ("work_description", "largest term weight", "double", "Weight of the description's rarest term"),
    "nearest_similarity_score": ("work_description", "largest cosine within the place", "double", "Likeness to the most similar other work"),
    "similar_project_count": ("work_description", "works within the place at or above the cosine limit", "int", "Number of works described alike"),
    "constituency_max_vendor_share": ("payments by vendor", "largest share of the constituency's spending", "double", "Weight of the constituency's main vendor"),
    "constituency_avg_vendor_transaction": ("payments by vendor", "mean of the vendors' mean payments", "double", "Usual payment in the constituency"),
    "constituency_vendor_count": ("payments by vendor", "number of vendors", "double", "Vendors paid in the constituency"),
    "constituency_avg_vendor_repeat_rate": ("payments by vendor", "mean of the vendors' repeat rates", "double", "How often vendors are paid again"),
    "constituency_pending_payment_ratio": ("payments by vendor", "mean of the vendors' pending shares", "double", "Share of payments still open"),
}


def active_features() -> list[str]:
    return [name for name, used in FEATURES.items() if used]


def with_all_features(
    works: DataFrame, payments: DataFrame, sponsors: DataFrame, p: Params = Params(), sizes: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Works with every feature family as added columns: no glue by row position, no row key needed."""
    df = with_financial(works, sponsors, p, sizes=sizes)
    df = with_temporal(df, payments, p, source=works)
    df = with_text(df, p, source=works)
    return with_vendor_cohort(df, cohort_inputs(payments))


def pre_imputation(featured: DataFrame) -> DataFrame:
    return quality.without_infinite(featured, FEATURES)


def fit_fills(featured: DataFrame) -> dict[str, float]:
    return quality.fit_imputer(pre_imputation(featured), FEATURES, CONSTANT_FILLS)


def impute_features(featured: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    fill = fit_fills(featured)
    return quality.impute(pre_imputation(featured), fill), fill


def feature_matrix(featured: DataFrame) -> DataFrame:
    filled, _ = impute_features(featured)
    return filled.select(*ID_COLUMNS, *FEATURES)


def feature_dictionary(featured: DataFrame) -> DataFrame:
    """One row per column of the matrix with its share of missing values before imputation."""
    names = [*ID_COLUMNS, *FEATURES]
    profile = quality.profile(pre_imputation(featured).select(*names), "matrix").select("column_name", "null_percentage")
    spark = featured.sparkSession
    facts = spark.createDataFrame(
        [(i, n, *DICTIONARY[n], bool(FEATURES.get(n, False))) for i, n in enumerate(names)],
        "position int, feature_name string, source_column string, formula string, data_type string, description string, used_for_model boolean",
    )
    return facts.join(profile, facts.feature_name == profile.column_name).select(
        "position", "feature_name", "source_column", "formula", "data_type", "description",
        rounded(F.col("null_percentage"), 2).alias("missing_percentage"), "used_for_model",
    )


def model_features(dictionary: DataFrame) -> list[str]:
    """Names of the features the model uses, in matrix order, read from the dictionary."""
    rows = dictionary.where("used_for_model").orderBy("position").select("feature_name").collect()
    return [row[0] for row in rows]
