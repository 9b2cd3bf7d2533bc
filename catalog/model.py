"""Registered queries: evaluation of model scores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.inputs import P, analysed_works, scored_works, tidy
from catalog.oracles import ACTIVE_LIST, STEPS, oracle, quantile, r, tidy as sql_tidy
from catalog.registry import query
from worklens.functions.ranks import even_bucket, mean_rank, quantiles, value_positions
from worklens.operators import iforest
from worklens.plans import evaluate, matrix
from worklens.sources.staging import settle, stage_root


MOMENTS = "mean std skew kurtosis p1 p5 p25 p50 p75 p95 p99"
_points = ", ".join(f"{quantile('value', p)} AS {n}" for n, p in evaluate.SCORE_POINTS.items())
STEPS["long_scores"] = "SELECT 'raw_anomaly_score' AS feature, raw_anomaly_score AS value FROM model UNION ALL SELECT 'normalized_anomaly_score', sev FROM model"
STEPS["score_means"] = "SELECT feature, avg(value) AS m FROM long_scores GROUP BY feature"
STEPS["score_moments"] = f"""
    SELECT feature, avg(value) AS mean, stddev_samp(value) AS std,
           avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5 AS skew, kurtosis_pop(value) AS kurtosis, {_points}
    FROM long_scores JOIN score_means USING (feature) GROUP BY feature"""


@query(oracle(sql_tidy("score_moments", MOMENTS)))
def score_distribution(spark, sf):
    return tidy(evaluate.score_moments(analysed_works(spark, sf), ["raw_anomaly_score", "normalized_anomaly_score"]), MOMENTS)


STEPS["flagged"] = "SELECT f.*, m.is_anomaly, m.raw_anomaly_score, m.sev FROM filled f JOIN model m USING (work_id)"
STEPS["long_flagged"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::double AS value, is_anomaly FROM flagged" for c in ACTIVE_LIST)
STEPS["effects0"] = """
    SELECT feature, avg(value) FILTER (WHERE is_anomaly = 1) AS mean_anom, stddev_samp(value) FILTER (WHERE is_anomaly = 1) AS std_anom,
           avg(value) FILTER (WHERE is_anomaly = 0) AS mean_norm, stddev_samp(value) FILTER (WHERE is_anomaly = 0) AS std_norm
    FROM long_flagged GROUP BY feature"""
STEPS["effects"] = """
    SELECT *, abs(cohens_d) AS abs_cohens_d FROM (
        SELECT *, CASE WHEN sqrt((std_anom * std_anom + std_norm * std_norm) / 2) > 0
            THEN (mean_anom - mean_norm) / sqrt((std_anom * std_anom + std_norm * std_norm) / 2) ELSE 0 END AS cohens_d FROM effects0)"""
EFFECTS = "mean_anom std_anom mean_norm std_norm cohens_d abs_cohens_d"


@query(oracle(sql_tidy("effects", EFFECTS, 4)))
def effect_sizes(spark, sf):
    return tidy(evaluate.effect_sizes(analysed_works(spark, sf), matrix.active_features()), EFFECTS, 4)


@query(oracle(f"SELECT feature, {r('cohens_d', 4)} AS cohens_d FROM effects ORDER BY abs_cohens_d DESC, feature LIMIT 5"))
def strongest_effects(spark, sf):
    effects = evaluate.effect_sizes(analysed_works(spark, sf), matrix.active_features())
    return tidy(evaluate.strongest_effects(effects, 5).select("feature", "cohens_d"), "cohens_d", 4)


BOX_FEATURES = ["cost_deviation", "constituency_max_vendor_share", "year_over_year_change", "effective_amount"]
BOX = "q1 median q3 low high"
STEPS["boxes0"] = f"""
    SELECT is_anomaly, feature, {quantile('value', .25)} AS q1, {quantile('value', .5)} AS median, {quantile('value', .75)} AS q3
    FROM long_flagged WHERE feature IN ({', '.join(repr(f) for f in BOX_FEATURES)}) GROUP BY ALL"""
STEPS["boxes"] = """
    SELECT is_anomaly, feature, q1, median, q3, min(value) AS low, max(value) AS high FROM long_flagged JOIN boxes0 USING (is_anomaly, feature)
    WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL"""


@query(oracle(sql_tidy("boxes", BOX, 4)))
def boxplot_summary(spark, sf):
    return tidy(evaluate.boxplots(analysed_works(spark, sf), BOX_FEATURES, "is_anomaly"), BOX, 4)


@query(oracle("SELECT least(floor((sev - lo) / ((hi - lo) / 50)), 49)::int AS bin, count(*) AS rows FROM model, (SELECT min(sev) AS lo, max(sev) AS hi FROM model) GROUP BY ALL"))
def anomaly_score_histogram(spark, sf):
    return evaluate.histogram(analysed_works(spark, sf), "normalized_anomaly_score", 50)


@query(oracle(f"SELECT project_status, count(*) AS total, sum(is_anomaly)::bigint AS flagged, {r('100.0::double * avg(is_anomaly)')} AS rate_pct FROM model GROUP BY project_status"))
def anomaly_rate_by_status(spark, sf):
    return tidy(evaluate.rate_by(analysed_works(spark, sf), "project_status"), "rate_pct")


@query(oracle(f"""
    SELECT *, {r("100.0::double * impossible_dates_count / total_anomalies")} AS impossible_dates_pct,
           {r("100.0::double * covid_era_count / total_anomalies")} AS covid_era_pct,
           {r("100.0::double * zero_amount_count / total_anomalies")} AS zero_amount_pct FROM (
        SELECT count(*) AS total_anomalies, count(*) FILTER (WHERE is_impossible_date_sequence = 1) AS impossible_dates_count,
               count(*) FILTER (WHERE is_covid_era = 1) AS covid_era_count, count(*) FILTER (WHERE effective_amount = 0) AS zero_amount_count
        FROM flagged WHERE is_anomaly = 1)"""))
def anomaly_sanity_checks(spark, sf):
    return tidy(evaluate.sanity(analysed_works(spark, sf)), "impossible_dates_pct covid_era_pct zero_amount_pct")


@query(oracle("SELECT work_id, sev AS normalized_anomaly_score, final_risk_score, risk_category, category, effective_amount FROM scores ORDER BY sev DESC, work_id LIMIT 10"))
def top_anomaly_review(spark, sf):
    return evaluate.top_anomalies(scored_works(spark, sf)).select(
        "work_id", "normalized_anomaly_score", "final_risk_score", "risk_category", "category", "effective_amount")


_cuts = "(SELECT " + ", ".join(f"{quantile('raw_anomaly_score', c)} AS c{i}" for i, c in enumerate(P.sensitivity)) + " FROM model)"


@query(oracle(" UNION ALL ".join(f"""
    SELECT 'contamination_sensitivity' AS metric_type, '42' AS seed_id, {c}::double AS contamination,
           count(*) FILTER (WHERE raw_anomaly_score < c{i}) AS anomalies_flagged, {c}::double AS mean_score,
           {r(f"100.0::double * count(*) FILTER (WHERE raw_anomaly_score < least(c{i}, c2)) / least(count(*) FILTER (WHERE raw_anomaly_score < c{i}), count(*) FILTER (WHERE raw_anomaly_score < c2))")} AS std_score,
           1.0::double AS spearman_rho_vs_baseline,
           {r(f"count(*) FILTER (WHERE raw_anomaly_score < least(c{i}, c2))::double / count(*) FILTER (WHERE raw_anomaly_score < greatest(c{i}, c2))")} AS jaccard_vs_baseline
    FROM model, {_cuts}""" for i, c in enumerate(P.sensitivity))))
def contamination_sensitivity(spark, sf):
    df = evaluate.sensitivity(analysed_works(spark, sf), "raw_anomaly_score", P.sensitivity, P.contamination, P.seed)
    return tidy(df, "std_score jaccard_vs_baseline")


@query(oracle(f"""
    SELECT 'effective_amount' AS "first", 'raw_anomaly_score' AS "second", {r("corr(ra, rb)")} AS rho FROM (
        SELECT rank() OVER (ORDER BY effective_amount) + (count(*) OVER (PARTITION BY effective_amount) - 1) / 2.0::double AS ra,
               rank() OVER (ORDER BY raw_anomaly_score) + (count(*) OVER (PARTITION BY raw_anomaly_score) - 1) / 2.0::double AS rb FROM flagged)"""))
def rank_correlation(spark, sf):
    return tidy(evaluate.spearman(analysed_works(spark, sf), [("effective_amount", "raw_anomaly_score")]), "rho")


@query(oracle(f"""
    SELECT {r("count(*) FILTER (WHERE a AND b)::double / count(*) FILTER (WHERE a OR b)")} AS jaccard,
           {r("100.0::double * count(*) FILTER (WHERE a AND b) / least(count(*) FILTER (WHERE a), count(*) FILTER (WHERE b))")} AS retention_pct
    FROM (SELECT is_anomaly = 1 AS a, is_impossible_date_sequence = 1 AS b FROM flagged)"""))
def flag_set_overlap(spark, sf):
    jaccard, kept = evaluate.overlap(F.col("is_anomaly") == 1, F.col("is_impossible_date_sequence") == 1)
    return tidy(analysed_works(spark, sf).agg(jaccard.alias("jaccard"), kept.alias("retention_pct")), "jaccard retention_pct")


@query(oracle(f"SELECT work_id, {r('(hi - raw_anomaly_score) / (hi - lo)')} AS normalized_anomaly_score FROM model, (SELECT min(raw_anomaly_score) AS lo, max(raw_anomaly_score) AS hi FROM model)"))
def anomaly_severity(spark, sf):
    return iforest.severity(analysed_works(spark, sf).select("work_id", "raw_anomaly_score")).drop("raw_anomaly_score")


@query(oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS feature_name, {r(f'100.0::double * (count(*) - count({c})) / count(*)', 2)} AS missing_percentage FROM filled" for c in ACTIVE_LIST)))
def model_feature_choice(spark, sf):
    """The features that the dictionary of these works gives to the model, with their share of missing values."""
    dictionary = matrix.feature_dictionary(analysed_works(spark, sf))
    return dictionary.where(F.col("feature_name").isin(matrix.model_features(dictionary))).select("feature_name", "missing_percentage")


@query(oracle("SELECT project_status, count(*) AS works, 0::bigint AS flags_off, 0::bigint AS labels_off, 0::bigint AS severity_off, true AS cut_is_quantile FROM works GROUP BY project_status"))
def forest_properties(spark, sf):
    """What must hold for fitted scores: flags and labels follow the sign, severity is the rescaled score, and the cut between
    flagged and other works is the quantile of the scores that the contamination names."""
    _, out = iforest.detect(analysed_works(spark, sf).select("work_id", "project_status", *matrix.active_features()), matrix.active_features(), P)
    out = settle(out.select("work_id", "project_status", "raw_anomaly_score", "normalized_anomaly_score", "anomaly_label", "is_anomaly"), "fitted")
    s = F.col("raw_anomaly_score")
    low, high = out.agg(F.min(s), F.max(s)).first()
    cut = quantiles(out, s, {"cut": P.contamination}, even_bucket(1.0 / 4096)).first()["cut"]
    return out.groupBy("project_status").agg(
        F.count_distinct("work_id").alias("works"),
        F.count_if((s < 0) != (F.col("is_anomaly") == 1)).alias("flags_off"),
        F.count_if((s < 0) != (F.col("anomaly_label") == -1)).alias("labels_off"),
        F.count_if(F.abs(F.col("normalized_anomaly_score") - (high - s) / (high - low)) > 1e-6).alias("severity_off"),
        F.lit(abs(cut) < 1e-9).alias("cut_is_quantile"),
    )


@query(oracle("SELECT project_status, count(*) AS works, 0::bigint AS scores_off, 0::bigint AS flags_off FROM works GROUP BY project_status"))
def saved_model_properties(spark, sf):
    """A forest read back from its tables gives every work the score and flag of the fitted one."""
    df = analysed_works(spark, sf).select("work_id", "project_status", *matrix.active_features())
    forest = iforest.fit(df, matrix.active_features(), P)
    path = f"{stage_root(spark)}/model-{uuid.uuid4().hex}"
    iforest.save(forest, path)
    kept = ["work_id", "project_status", "raw_anomaly_score", "is_anomaly"]
    mine = forest.score(df).select(*kept)
    again = iforest.load(spark, path).score(df).select("work_id", F.col("raw_anomaly_score").alias("s"), F.col("is_anomaly").alias("f"))
    return mine.join(again, "work_id").groupBy("project_status").agg(
        F.count(F.lit(1)).alias("works"),
        F.count_if(F.abs(F.col("raw_anomaly_score") - F.col("s")) > 1e-12).alias("scores_off"),
        F.count_if(F.col("is_anomaly") != F.col("f")).alias("flags_off"),
    )


_SEEDS = list(P.stability_seeds)
_kinds = [("seed_instance", len(_SEEDS)), ("pairwise_stability", len(_SEEDS) * (len(_SEEDS) - 1) // 2), ("contamination_sensitivity", len(P.sensitivity))]


@query(oracle(" UNION ALL ".join(f"SELECT '{k}' AS metric_type, {n}::bigint AS rows, count(*) AS works, 0::bigint AS counts_off, 0::bigint AS jaccard_off, 0::bigint AS rho_off FROM works" for k, n in _kinds)))
def stability_properties(spark, sf):
    """The stability table against flags, overlaps and rank correlations taken anew from the score columns."""
    df = analysed_works(spark, sf).select("work_id", *matrix.active_features())
    table = {(t["metric_type"], t["seed_id"], t["contamination"]): t for t in evaluate.seed_stability(df, matrix.active_features(), P).collect()}
    scores = settle(iforest.seed_scores(df, matrix.active_features(), _SEEDS, P), "scores-again")
    shares = sorted({*P.sensitivity, P.contamination})
    points = {f"c{j}": c for j, c in enumerate(shares)}
    cuts = [quantiles(scores, f"score_{s}", points, even_bucket(1.0 / 4096)).select(*points).first() for s in _SEEDS]
    flag = {(s, c): F.col(f"score_{s}") < cuts[i][j] for i, s in enumerate(_SEEDS) for j, c in enumerate(shares)}
    base, usual = _SEEDS[0], P.contamination
    wanted = [(("seed_instance", str(s), usual), (s, usual), (base, usual)) for s in _SEEDS]
    wanted += [(("pairwise_stability", f"{a}_vs_{b}", usual), (a, usual), (b, usual)) for i, a in enumerate(_SEEDS) for b in _SEEDS[i + 1:]]
    wanted += [(("contamination_sensitivity", str(P.seed), c), (base, c), (base, usual)) for c in P.sensitivity]
    for s in _SEEDS:
        places = value_positions(scores.withColumn("everything", F.lit(1)), ["everything"], f"score_{s}", even_bucket(1.0 / 4096))
        scores = scores.join(places.select(f"score_{s}", mean_rank().alias(f"rank_{s}")), f"score_{s}")
    aggregates = []
    for i, (_, a, b) in enumerate(wanted):
        either = F.count_if(flag[a] | flag[b])
        aggregates += [F.count_if(flag[a]).alias(f"n{i}"), F.try_divide(F.count_if(flag[a] & flag[b]).cast("double"), either.cast("double")).alias(f"j{i}"), F.corr(f"rank_{a[0]}", f"rank_{b[0]}").alias(f"r{i}")]
    again = scores.agg(F.count(F.lit(1)).alias("works"), *aggregates).first()
    rows = []
    for kind, _ in _kinds:
        mine = [(i, table[key]) for i, (key, *_) in enumerate(wanted) if key[0] == kind]
        off = lambda column, mark, most: sum(abs(t[column] - again[f"{mark}{i}"]) > most for i, t in mine)
        rho = "spearman_rho_vs_baseline"
        rows.append((kind, len(mine), again["works"], off("anomalies_flagged", "n", 0), off("jaccard_vs_baseline", "j", 1e-9), off(rho, "r", 1e-3)))
    return spark.createDataFrame(rows, "metric_type string, rows bigint, works bigint, counts_off bigint, jaccard_off bigint, rho_off bigint")


@query(oracle("""
    SELECT 0 AS position, 'works' AS stage, 'done' AS status, count(*) AS rows FROM works UNION ALL SELECT 1, 'payments', 'done', count(*) FROM payments
    UNION ALL SELECT 2, 'sponsors', 'done', count(*) FROM sponsors UNION ALL SELECT 3, 'features', 'done', count(*) FROM works
    UNION ALL SELECT 4, 'dictionary', 'done', """ + str(len(matrix.ID_COLUMNS) + len(matrix.FEATURES)) + """ UNION ALL SELECT 5, 'analysed', 'done', count(*) FROM works
    UNION ALL SELECT 6, 'model', 'done', count(*) FROM works UNION ALL SELECT 7, 'scored', 'done', count(*) FROM works UNION ALL SELECT 8, 'master', 'done', count(*) FROM works"""))
def batch_run_table(spark, sf):
    """The run table of a whole batch run."""
    from catalog.inputs import raw
    from worklens.plans import batch

    inputs = (raw(spark, sf, n) for n in ("recommended_raw", "completed_raw", "payments_raw", "sponsor_raw"))
    return batch.full_run(*inputs, P, stop=False).report(spark).select("position", "stage", "status", "rows")


@query()
def seed_stability(spark, sf):
    """Five seeds, pairwise rank correlation and Jaccard, and the sensitivity rows."""
    return evaluate.seed_stability(analysed_works(spark, sf), matrix.active_features(), P)


@query()
def model_saved_and_loaded(spark, sf):
    """Scores of a forest read back from its stored tables."""
    df = analysed_works(spark, sf).drop("raw_anomaly_score", "anomaly_label", "is_anomaly", "normalized_anomaly_score")
    forest = iforest.fit(df, matrix.active_features(), P)
    path = f"{stage_root(spark)}/model-{uuid.uuid4().hex}"
    iforest.save(forest, path)
    return iforest.load(spark, path).score(df).select("work_id", "raw_anomaly_score", "is_anomaly")
