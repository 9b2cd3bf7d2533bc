"""Roll-ups by state and constituency, overview, area status and signals.

Scores lie between 0 and 100 with two decimals, so a group has at most 10,001 different ones and the
built-in median is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions.scalars import exact_sum, recode, rounded
from worklens.operators.quality import value_shares
from worklens.params import Params

# Region names that differ between the works and the map.
MAP_NAMES = {
    "The Dadra And Nagar Haveli And Daman And Diu": "Dadra and Nagar Haveli",
    "Andaman And Nicobar Islands": "Andaman and Nicobar Islands",
    "Andaman & Nicobar Islands": "Andaman and Nicobar Islands",
    "Jammu And Kashmir": "Jammu and Kashmir",
    "Jammu & Kashmir": "Jammu and Kashmir",
}


def _is(level: str) -> Column:
    return F.count_if(F.col("risk_category") == level)


def _derived(df: DataFrame) -> DataFrame:
    pct = F.try_divide(F.col("high_risk_works").cast("double"), F.col("total_works").cast("double")) * 100.0
    return df.withColumns(
        {"high_risk_pct": rounded(pct, 2), "area_risk_score": rounded(F.col("median_risk_score"), 1)}
    )


def with_area_status(df: DataFrame, high_works: int, min_works: int) -> DataFrame:
    """Compares rounded values, as shown to the reader."""
    score, pct = F.col("area_risk_score"), F.col("high_risk_pct")
    status = (
        F.when(F.col("total_works") < min_works, "INSUFFICIENT DATA")
        .when((score >= 50.0) | (pct >= 10.0) | (F.col("high_risk_works") >= high_works), "HIGH")
        .when((score >= 40.0) | (pct >= 2.0), "MEDIUM")
        .otherwise("LOW")
    )
    return df.withColumn("area_status", status)


def state_rollup(master: DataFrame, p: Params = Params()) -> DataFrame:
    rolled = (
        master.where(F.col("state").isNotNull())
        .groupBy("state")
        .agg(
            F.count("work_id").alias("total_works"),
            _is("HIGH").alias("high_risk_works"),
            _is("MEDIUM").alias("med_risk_works"),
            _is("LOW").alias("low_risk_works"),
            F.median("final_risk_score").alias("median_risk_score"),
            rounded(F.try_divide(exact_sum(F.col("final_risk_score")), F.count("final_risk_score")), 6).alias("avg_risk_score"),
            exact_sum(F.col("effective_amount")).alias("total_amount"),
        )
    )
    return with_area_status(_derived(rolled), p.state_high_works, p.min_works)


SIGNALS = {
    "high_z_count": lambda p: F.col("cost_z_score") > p.z_cut,
    "high_sim_count": lambda p: F.col("nearest_similarity_score") >= p.similar_at,
    "high_iso_count": lambda p: F.col("isolation_forest_score") >= 55.0,
    "imp_date_count": lambda p: F.col("is_impossible_date_sequence") == 1,
}


def signal_counts(p: Params) -> list[Column]:
    return [F.count_if(rule(p)).alias(name) for name, rule in SIGNALS.items()]


def constituency_rollup(master: DataFrame, p: Params = Params(), min_works: int | None = None) -> DataFrame:
    rolled = (
        master.where(F.col("state").isNotNull() & F.col("constituency").isNotNull())
        .groupBy("state", "constituency")
        .agg(
            F.count("work_id").alias("total_works"),
            _is("HIGH").alias("high_risk_works"),
            _is("MEDIUM").alias("medium_risk_works"),
            _is("LOW").alias("low_risk_works"),
            F.median("final_risk_score").alias("median_risk_score"),
            *signal_counts(p),
        )
    )
    return with_area_status(_derived(rolled), p.constituency_high_works, p.min_works if min_works is None else min_works)


def rank_in_state(areas: DataFrame) -> DataFrame:
    """Rank of each constituency in its state. Rows are areas, so a state has few."""
    order = Window.partitionBy("state").orderBy(F.desc("area_risk_score"))
    return areas.withColumn("rank_in_state", F.rank().over(order))


def state_signals(master: DataFrame, p: Params = Params()) -> DataFrame:
    """Signal counts, total amount and one sentence per signal for every state."""
    rows = master.where(F.col("state").isNotNull()).groupBy("state").agg(
        *signal_counts(p), exact_sum(F.col("effective_amount")).alias("total_amount")
    )
    return rows.withColumn("signals", signal_text(STATE_SENTENCES, "state"))


# Sentences of the signal lists.
STATE_SENTENCES = {
    "high_z_count": " project(s) exhibit unusually high cost compared with historical benchmarks (Z-Score > 2.5).",
    "high_sim_count": " project(s) show high description text similarity (>= 85% cosine match) with existing works.",
    "high_iso_count": " project(s) exhibit multi-dimensional feature isolation flagged by Isolation Forest.",
    "imp_date_count": " project(s) contain invalid date chronology sequences.",
}
CONSTITUENCY_SENTENCES = {
    "high_z_count": " project(s) exhibit unusually high cost compared with historical benchmarks.",
    "high_sim_count": " project(s) show high text similarity (>= 85%) with existing descriptions.",
    "high_iso_count": " project(s) exhibit unusual feature isolation patterns.",
    "imp_date_count": " project(s) contain invalid date chronology flags.",
}


def signal_text(sentences: dict[str, str], level: str) -> Column:
    lines = [
        F.when(F.col(name) > 0, F.concat(F.lit("• "), F.col(name).cast("string"), F.lit(text)))
        for name, text in sentences.items()
    ]
    joined = F.concat_ws("\n", *lines)
    return F.when(joined == "", f"• All projects in this {level} operate within standard baseline bounds.").otherwise(joined)


def constituency_signals(areas: DataFrame) -> DataFrame:
    return areas.withColumn("signals", signal_text(CONSTITUENCY_SENTENCES, "constituency"))


def overview(master: DataFrame) -> DataFrame:
    """Totals, counts and shares per category, mean score and amount, as one row."""
    n = F.count(F.lit(1))
    one = master.agg(
        n.alias("total_projects"),
        _is("HIGH").alias("high_risk_count"),
        _is("MEDIUM").alias("medium_risk_count"),
        _is("LOW").alias("low_risk_count"),
        rounded(F.try_divide(exact_sum(F.col("final_risk_score")), F.count("final_risk_score")), 2).alias("average_risk_score"),
        exact_sum(F.col("effective_amount")).alias("total_effective_amount"),
    )
    share = {
        f"{level}_risk_pct": rounded(F.try_divide(F.col(f"{level}_risk_count") * 100.0, F.col("total_projects")), 2)
        for level in ("high", "medium", "low")
    }
    return one.withColumns(share)


def top_states(master: DataFrame, top: int = 10) -> DataFrame:
    rows = master.where(F.col("state").isNotNull()).groupBy("state").agg(
        rounded(F.median("final_risk_score"), 1).alias("median_risk_score")
    )
    return rows.orderBy(F.desc("median_risk_score"), "state").limit(top)


def sponsor_totals(master: DataFrame) -> DataFrame:
    """Sponsor-level amounts summed once per sponsor instead of once per work."""
    columns = ["mp_allocated_amount", "mp_total_expenditure", "mp_completed_works"]
    one = master.groupBy("mp_name").agg(*[F.max(c).alias(c) for c in columns])
    return one.agg(
        exact_sum(F.col("mp_allocated_amount")).alias("total_allocated"),
        exact_sum(F.col("mp_total_expenditure")).alias("total_mp_expenditure"),
        F.sum("mp_completed_works").alias("total_completed_works"),
    )


def high_risk_by_state(master: DataFrame, top: int = 10) -> DataFrame:
    rows = master.where((F.col("risk_category") == "HIGH") & F.col("state").isNotNull())
    counts = rows.groupBy("state").agg(F.count(F.lit(1)).alias("high_risk_count"))
    return counts.orderBy(F.desc("high_risk_count"), "state").limit(top)


def category_counts(master: DataFrame, column: str = "risk_category") -> DataFrame:
    return value_shares(master, column)


def score_band(score: Column) -> Column:
    return (
        F.when(score < 40, "Low (0-39)")
        .when(score < 55, "Moderate (40-54)")
        .when(score < 70, "Elevated (55-69)")
        .otherwise("High (70-100)")
    )


def map_name(state: Column) -> Column:
    return recode(state, MAP_NAMES)
