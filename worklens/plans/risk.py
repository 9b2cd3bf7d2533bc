"""Component scores, weighted score, category and evidence text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.scalars import clip, fixed, grouped, holds, rounded
from worklens.params import Params
from worklens.plans.clean import per_sponsor
from worklens.sources.staging import attach

COMPONENTS = [
    "financial_score", "temporal_score", "vendor_score", "isolation_forest_score", "nlp_similarity_score",
    "mp_works_risk_score",
]
SPONSOR_METRICS = [
    "allocated_amount", "total_expenditure", "utilization_pct", "completed_works_count", "recommended_works_count",
    "completion_rate_pct",
]


def _or0(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def financial_score() -> Column:
    deviation = clip(clip(F.col("z_score"), 0.0, 10.0) * 10.0, 0.0, 100.0)
    return clip(0.6 * clip(F.col("percentile"), 0.0, 100.0) + 0.4 * deviation, 0.0, 100.0)


def temporal_score() -> Column:
    growth = clip(clip(_or0("year_over_year_change"), 0.0, 1000.0) / 10.0, 0.0, 100.0)
    return F.when(holds(F.col("is_impossible_date_sequence") == 1), 100.0).otherwise(growth)


def vendor_score() -> Column:
    share = clip(_or0("constituency_max_vendor_share"), 0.0, 1.0) * 100.0
    pending = clip(clip(_or0("constituency_pending_payment_ratio"), 0.0, 1.0) * 200.0, 0.0, 100.0)
    repeat = clip(_or0("constituency_avg_vendor_repeat_rate"), 0.0, 1.0) * 100.0
    return clip(0.5 * share + 0.3 * pending + 0.2 * repeat, 0.0, 100.0)


def percent_of(name: str) -> Column:
    return clip(clip(_or0(name), 0.0, 1.0) * 100.0, 0.0, 100.0)


def works_risk_score() -> Column:
    return clip(100.0 - F.coalesce("completion_rate_pct", F.lit(50.0)), 0.0, 100.0)


def with_sponsor_metrics(works: DataFrame, sponsors: DataFrame) -> DataFrame:
    """Sponsor's totals and completion rate, joined on name and constituency so nothing fans out."""
    return attach(works, per_sponsor(sponsors, SPONSOR_METRICS), ["mp_name", "constituency"], "sponsor-metrics")


def with_components(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "financial_score": financial_score(),
            "temporal_score": temporal_score(),
            "vendor_score": vendor_score(),
            "isolation_forest_score": percent_of("normalized_anomaly_score"),
            "nlp_similarity_score": percent_of("nearest_similarity_score"),
            "mp_works_risk_score": works_risk_score(),
        }
    )


def category_of(score: Column, p: Params = Params()) -> Column:
    return F.when(score <= p.low_max, "LOW").when(score <= p.medium_max, "MEDIUM").otherwise("HIGH")


def with_final_score(df: DataFrame, p: Params = Params()) -> DataFrame:
    total = (
        p.w_financial * F.col("financial_score")
        + p.w_temporal * F.col("temporal_score")
        + p.w_isolation * F.col("isolation_forest_score")
        + p.w_vendor * F.col("vendor_score")
        + p.w_works * F.col("mp_works_risk_score")
    )
    df = df.withColumn("final_risk_score", rounded(F.coalesce(total, F.lit(0.0)), 2))
    return df.withColumn("risk_category", category_of(F.col("final_risk_score"), p))


def evidence(p: Params = Params()) -> Column:
    """Up to six bullets under a header. Each bullet is null unless its rule holds; ``concat_ws`` skips nulls.

    Wording states deviations only and asserts no wrongdoing.
    """
    # The sentences and limits below.
    c = F.col

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.coalesce(x if isinstance(x, Column) else F.lit(x), F.lit("nan")) for x in parts])

    cost = F.when(
        holds(c("z_score") > p.z_cut) | holds(c("percentile") >= p.upper_pct) | holds(c("financial_score") >= 65.0),
        text(
            "• Financial Benchmark Deviation: Expenditure of ₹", grouped(c("effective_amount"), 2),
            " is unusually high compared with ", c("baseline_group"), " benchmark mean of ₹", grouped(c("group_mean"), 2),
            " (Z-Score: +", fixed(c("z_score"), 2), ", Cohort Percentile: ", fixed(c("percentile"), 1), "%).",
        ),
    ).when(
        holds(c("effective_amount") > c("group_p99")),
        text(
            "• Upper-Tail Expenditure: Project cost ₹", grouped(c("effective_amount"), 2),
            " exceeds the 99th percentile cohort ceiling of ₹", grouped(c("group_p99"), 2), ".",
        ),
    )
    dates = F.when(
        holds(c("is_impossible_date_sequence") == 1),
        text("• Invalid Date Chronology: Completion date precedes recommendation date (impossible negative duration sequence)."),
    ).when(
        holds(c("temporal_score") >= 60.0) | holds(c("year_over_year_change") >= 200.0),
        text(
            "• Constituency Project Volume Spike: Annual recommendation volume grew by +",
            fixed(c("year_over_year_change"), 1),
            "% YoY, indicating an unusual concentration of project approvals.",
        ),
    )
    vendors = F.when(
        holds(c("constituency_max_vendor_share") >= 0.40) | holds(c("vendor_score") >= 60.0),
        text(
            "• Vendor Expenditure Concentration: Single vendor commands ",
            fixed(c("constituency_max_vendor_share") * 100.0, 1),
            "% of total constituency expenditure, exceeding normal competitive distribution thresholds.",
        ),
    ).when(
        holds(c("constituency_pending_payment_ratio") >= 0.15),
        text(
            "• Pending Payment Ratio: Constituency exhibits ", fixed(c("constituency_pending_payment_ratio") * 100.0, 1),
            "% pending transaction ratio across active vendors.",
        ),
    )
    completion = F.when(
        holds(c("completion_rate_pct") < 50.0),
        text(
            "• Low Constituency Works Completion Rate: MP exhibits a low completion rate of ",
            fixed(c("completion_rate_pct"), 1), "% (", c("completed_works_count").cast("string"), " completed out of ",
            c("recommended_works_count").cast("string"),
            " recommended works), signaling elevated execution backlog risk.",
        ),
    )
    model = F.when(
        holds(c("is_anomaly") == 1) | holds(c("isolation_forest_score") >= 55.0),
        text(
            "• Isolation Forest Machine Learning Pattern: Multi-dimensional feature isolation detected across combined "
            "financial, temporal, and vendor space (Model Severity: ",
            fixed(c("isolation_forest_score"), 1),
            "/100).",
        ),
    )
    alike = F.when(
        holds(c("nearest_similarity_score") >= p.similar_at),
        text(
            "• Text Similarity Candidate: Work description matches ", c("similar_project_count").cast("int").cast("string"),
            " other project(s) in constituency with high text similarity (",
            fixed(c("nearest_similarity_score") * 100.0, 1), "% cosine match score).",
        ),
    )
    bullets = F.concat_ws("\n", cost, dates, vendors, completion, model, alike)
    score = F.concat(F.lit(" (Final Risk Score: "), fixed(c("final_risk_score"), 2), F.lit("/100):"))
    title = (
        F.when(c("risk_category") == "HIGH", "High priority for verification")
        .when(c("risk_category") == "MEDIUM", "Priority for verification")
        .otherwise("Standard baseline record")
    )
    plain = F.concat(F.lit("Standard baseline record"), score, F.lit(" Project execution within expected cohort parameters."))
    return F.when(bullets == "", plain).otherwise(F.concat(title, score, F.lit("\n"), bullets))


def with_risk(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Needs features, baseline, sponsor metrics, ``normalized_anomaly_score`` and ``is_anomaly``."""
    df = with_final_score(with_components(df), p)
    return df.withColumn("explanation", evidence(p))


def risk_scores(scored: DataFrame) -> DataFrame:
    return scored.select(
        "work_id", *[rounded(F.col(c), 2).alias(c) for c in COMPONENTS], "final_risk_score", "risk_category", "explanation"
    )
