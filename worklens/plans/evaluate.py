"""Evaluation of the model: score moments, effect sizes, stability, sensitivity, sanity checks."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.ranks import even_bucket, group_quantiles, mean_rank, quantiles, value_positions
from worklens.operators import iforest, quality
from worklens.params import Params
from worklens.sources.staging import settle

SCORE_BUCKET = even_bucket(1.0 / 4096)
SCORE_POINTS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def score_moments(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Mean, sample deviation, population skew, excess kurtosis and percentiles per score column."""
    rows = quality.long_form(df, columns)
    moments = rows.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.skewness("value").alias("skew"),
        F.kurtosis("value").alias("kurtosis"),
    )
    return moments.join(group_quantiles(rows, ["feature"], "value", SCORE_POINTS, SCORE_BUCKET), "feature")


def effect_sizes(df: DataFrame, features: Iterable[str], flagged: str = "is_anomaly") -> DataFrame:
    """Cohen's d per feature between flagged and other rows; 0 where both groups are flat."""
    rows = quality.long_form(df, features, [flagged])
    yes, no = F.col(flagged) == 1, F.coalesce(F.col(flagged) != 1, F.lit(True))
    stats = rows.groupBy("feature").agg(
        F.avg(F.when(yes, F.col("value"))).alias("mean_anom"),
        F.stddev_samp(F.when(yes, F.col("value"))).alias("std_anom"),
        F.avg(F.when(no, F.col("value"))).alias("mean_norm"),
        F.stddev_samp(F.when(no, F.col("value"))).alias("std_norm"),
    )
    pooled = F.sqrt((F.col("std_anom") * F.col("std_anom") + F.col("std_norm") * F.col("std_norm")) / 2.0)
    d = F.when(pooled > 0, (F.col("mean_anom") - F.col("mean_norm")) / pooled).otherwise(0.0)
    return stats.withColumn("cohens_d", d).withColumn("abs_cohens_d", F.abs("cohens_d"))


def strongest_effects(effects: DataFrame, k: int) -> DataFrame:
    return effects.orderBy(F.desc("abs_cohens_d"), "feature").limit(k)


def boxplots(df: DataFrame, features: Iterable[str], group: str) -> DataFrame:
    """Quartiles, and whiskers as the outermost values within 1.5 interquartile ranges."""
    rows = quality.long_form(df, features, [group])
    keys = [group, "feature"]
    box = group_quantiles(rows, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, bucket=_any())
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(settle(box, "boxes"), keys).where(F.col("value").between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*keys, "q1", "median", "q3").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def _any():
    from worklens.functions.ranks import ANY

    return ANY


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    by = by or []
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        low, high = 0.0, 1.0
    width = (high - low) / bins or 1.0
    n = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(n.alias("bin"), *by).agg(F.count(F.lit(1)).alias("rows"))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(Jaccard, share of the smaller set kept in percent) of two flag columns."""
    both, either = F.count_if(a & b).cast("double"), F.count_if(a | b).cast("double")
    smaller = F.least(F.count_if(a), F.count_if(b)).cast("double")
    return F.try_divide(both, either), F.try_divide(both, smaller) * 100.0


def with_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average-tie rank over all rows, joined back by value."""
    ranks = value_positions(df.select(F.lit(1).alias("_all"), column), ["_all"], column, SCORE_BUCKET)
    return df.join(ranks.select(column, mean_rank().alias(out)), column, "left")


def spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rank correlation per pair of columns."""
    columns = sorted({c for pair in pairs for c in pair})
    ranked = df.select(*columns)
    for c in columns:
        ranked = with_rank(ranked, c, f"_rank_{c}")
    ranked = settle(ranked.select(*[f"_rank_{c}" for c in columns]), "ranks")
    one = ranked.agg(*[F.corr(f"_rank_{a}", f"_rank_{b}").alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"_r{i}").alias("rho"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.inline(F.array(*rows)))


STABILITY = "metric_type string, seed_id string, contamination double, anomalies_flagged bigint, mean_score double, std_score double, spearman_rho_vs_baseline double, jaccard_vs_baseline double"


def sensitivity(df: DataFrame, score: str, shares: Iterable[float], base: float, seed: int) -> DataFrame:
    """Rows flagged at several contaminations. One score column and several cuts, no refit."""
    shares = list(shares)
    named = {f"c{i}": c for i, c in enumerate(shares)}
    cuts = quantiles(df, score, {**named, "base": base}, SCORE_BUCKET).first()
    base_flag = F.col(score) < cuts["base"]
    aggregates = []
    for i in range(len(shares)):
        own = F.col(score) < cuts[f"c{i}"]
        jaccard, kept = overlap(own, base_flag)
        aggregates += [F.count_if(own).alias(f"_n{i}"), jaccard.alias(f"_j{i}"), kept.alias(f"_k{i}")]
    rows = [
        F.struct(
            F.lit("contamination_sensitivity").alias("metric_type"), F.lit(str(seed)).alias("seed_id"),
            F.lit(c).alias("contamination"), F.col(f"_n{i}").alias("anomalies_flagged"), F.lit(c).alias("mean_score"),
            F.col(f"_k{i}").alias("std_score"), F.lit(1.0).alias("spearman_rho_vs_baseline"),
            F.col(f"_j{i}").alias("jaccard_vs_baseline"),
        )
        for i, c in enumerate(shares)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def seed_stability(df: DataFrame, features: list[str], p: Params = Params()) -> DataFrame:
    """Per seed and per pair of seeds: flags, score moments, rank correlation, Jaccard; then the sensitivity rows.

    The trees of all seeds grow in one job and score in one pass.
    """
    seeds = list(p.stability_seeds)
    scored = settle(
        iforest.seed_scores(df, features, seeds, p).select(*[f"score_{s}" for s in seeds]), "seed-scores"
    )
    cuts = {s: iforest.contamination_cut(scored, f"score_{s}", p.contamination) for s in seeds}
    flag = {s: F.col(f"score_{s}") < cuts[s] for s in seeds}
    pairs = list(combinations(seeds, 2))
    one = scored.agg(
        *[F.count_if(flag[s]).alias(f"_n{s}") for s in seeds],
        *[F.avg(F.col(f"score_{s}") - cuts[s]).alias(f"_m{s}") for s in seeds],
        *[F.stddev_pop(f"score_{s}").alias(f"_d{s}") for s in seeds],
        *[overlap(flag[a], flag[b])[0].alias(f"_j{a}_{b}") for a, b in pairs],
    ).first()
    rho = {(r["first"], r["second"]): r["rho"] for r in spearman(scored, [(f"score_{a}", f"score_{b}") for a, b in pairs]).collect()}

    def of(a: int, b: int) -> tuple[float, float]:
        if a == b:
            return 1.0, 1.0
        return rho[(f"score_{a}", f"score_{b}")], one[f"_j{a}_{b}"]

    base = seeds[0]
    rows = [("seed_instance", str(s), p.contamination, one[f"_n{s}"], one[f"_m{s}"], one[f"_d{s}"], *of(base, s)) for s in seeds]
    rows += [("pairwise_stability", f"{a}_vs_{b}", p.contamination, one[f"_n{a}"], 0.0, 0.0, *of(a, b)) for a, b in pairs]
    table = df.sparkSession.createDataFrame(rows, STABILITY)
    return table.unionByName(sensitivity(scored, f"score_{base}", p.sensitivity, p.contamination, base))


def top_anomalies(scored: DataFrame, k: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("normalized_anomaly_score"), "work_id").limit(k)


def sanity(df: DataFrame, flagged: str = "is_anomaly") -> DataFrame:
    """Suspicious record patterns inside the flagged set: counts and shares."""
    rows = df.where(F.col(flagged) == 1)
    one = rows.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_if(F.col("is_impossible_date_sequence") == 1).alias("impossible_dates_count"),
        F.count_if(F.col("is_covid_era") == 1).alias("covid_era_count"),
        F.count_if(F.col("effective_amount") == 0).alias("zero_amount_count"),
    )
    share = {
        f"{n}_pct": F.try_divide(F.col(f"{n}_count") * 100.0, F.col("total_anomalies"))
        for n in ("impossible_dates", "covid_era", "zero_amount")
    }
    return one.withColumns(share)


def rate_by(df: DataFrame, key: str, flagged: str = "is_anomaly") -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.sum(flagged).alias("flagged"), (F.avg(flagged) * 100.0).alias("rate_pct")
    )
