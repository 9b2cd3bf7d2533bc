"""Registered queries: profiling, data quality, scalar functions, windows, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    P, analysed_works, payments, raw, settled_payments, settled_works, sponsors, tidy, works,
)
from catalog.oracles import FEATURE_LIST, STEPS, _p, _z, dec, num, oracle, quantile, r, tidy as sql_tidy
from catalog.registry import query
from catalog.views import table, view
from worklens.functions import scalars
from worklens.operators import cohorts, quality
from worklens.plans import clean, matrix, temporal, vendor
from worklens.plans.financial import with_effective_amount, with_release_ratio

WORK_COLUMNS = clean.WORK_COLUMNS
PAY_COLUMNS = list(clean.PAYMENT_TITLES.values())


def _profile(name: str, source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS dataset, '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count,
            {r(f"100.0::double * (count(*) - count({c})) / count(*)", 4)} AS null_percentage FROM {source}"""
        for c in columns
    )


@query(oracle(_profile("projects_clean", "works", WORK_COLUMNS)))
def column_profile(spark, sf):
    return quality.profile(works(spark, sf), "projects_clean").drop("data_type")


_RULES = """CASE WHEN null_count = 0 THEN 'Complete (0% missing)'
    WHEN dataset = 'projects_clean' AND column_name IN ('completed_date', 'final_amount', 'category', 'average_rating')
        THEN 'Structural Missingness (Missing for uncompleted/recommended-only projects)'
    WHEN dataset = 'projects_clean' AND column_name IN ('recommended_amount', 'recommendation_date')
        THEN 'Structural Missingness (Missing for completed-only projects)'
    WHEN column_name IN ('average_rating', 'Average Rating') THEN 'MNAR (Missing Not At Random - optional feedback/rating submission)'
    WHEN column_name IN ('category', 'Category') THEN 'MAR (Missing At Random - category unassigned during data entry)'
    WHEN null_percentage < 1 THEN 'MCAR (Missing Completely At Random - sporadic missing text/description)'
    ELSE 'MAR (Missing At Random)' END AS missingness_classification"""


@query(oracle(f"SELECT *, {_RULES} FROM (" + " UNION ALL ".join([
    _profile("projects_clean", "works", WORK_COLUMNS),
    _profile("raw_completed_works", "completed_raw", list(clean.COMPLETED_TITLES.values())),
    _profile("mp_summary_clean", "sponsors", list(clean.SPONSOR_TITLES.values())),
]) + ")"))
def missingness_report(spark, sf):
    done = clean.canonical(raw(spark, sf, "completed_raw"), clean.COMPLETED_TITLES)
    profiles = quality.profile(works(spark, sf), "projects_clean")
    profiles = profiles.unionByName(quality.profile(done, "raw_completed_works"))
    profiles = profiles.unionByName(quality.profile(sponsors(spark, sf), "mp_summary_clean"))
    return quality.with_missingness(profiles).drop("data_type")


@query(oracle("""
    SELECT 'payments' AS dataset, count(*) AS row_count, 9 AS column_count FROM payments_raw UNION ALL
    SELECT 'recommended', count(*), 9 FROM recommended_raw UNION ALL SELECT 'completed', count(*), 11 FROM completed_raw
    UNION ALL SELECT 'sponsors', count(*), 13 FROM sponsor_raw"""))
def dataset_inventory(spark, sf):
    from worklens.sources.io import manifest

    tables = {n: raw(spark, sf, v) for n, v in (
        ("payments", "payments_raw"), ("recommended", "recommended_raw"), ("completed", "completed_raw"), ("sponsors", "sponsor_raw"))}
    return manifest(tables).select("dataset", "row_count", F.col("column_count").cast("int").alias("column_count"))


@query(oracle("SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM payments_raw)) AS distinct_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM payments_raw)) AS duplicate_rows FROM payments_raw"))
def exact_duplicates(spark, sf):
    return quality.exact_copies(raw(spark, sf, "payments_raw"))


@query(oracle("SELECT count(*) - count(DISTINCT l_orderkey) AS repeated_keys FROM lineitem"))
def repeated_keys(spark, sf):
    return quality.key_repeats(table(spark, sf, "lineitem"), "l_orderkey")


STEPS["long_feats"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::double AS value FROM filled" for c in FEATURE_LIST)
DESC = "mean std min p25 p50 p75 max"


@query(oracle(sql_tidy("(SELECT feature, count(value) AS usable, count(*) - count(value) AS missing, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, "
    + f"{quantile('value', .25)} AS p25, {quantile('value', .5)} AS p50, {quantile('value', .75)} AS p75, max(value) AS max FROM long_feats GROUP BY feature)", DESC, 5)))
def feature_statistics(spark, sf):
    return tidy(quality.describe(analysed_works(spark, sf), list(matrix.FEATURES)), DESC, 5)


@query(oracle("""
    SELECT feature, count(*) FILTER (WHERE abs(v) = 'inf'::double) AS infinite FROM (
        SELECT 'expenditure_ratio' AS feature, CASE WHEN recommended_amount > 0 AND final_amount IS NULL THEN 'inf'::double ELSE final_amount END AS v FROM works
        UNION ALL SELECT 'recommended_amount', recommended_amount FROM works) GROUP BY feature"""))
def infinite_values(spark, sf):
    df = works(spark, sf)
    odd = F.when((F.col("recommended_amount") > 0) & F.col("final_amount").isNull(), float("inf")).otherwise(F.col("final_amount"))
    return quality.infinite_counts(df.withColumn("expenditure_ratio", odd), ["expenditure_ratio", "recommended_amount"])


@query(oracle(f"SELECT work_id, {r('coalesce(recommended_amount, m)')} AS recommended_amount, coalesce(final_amount, 1.0)::double AS final_amount FROM works, (SELECT {quantile('recommended_amount', .5)} AS m FROM works)"))
def median_imputation(spark, sf):
    df = settled_works(spark, sf)
    fill = quality.fit_imputer(df, ["recommended_amount", "final_amount"], {"final_amount": 1.0})
    return tidy(quality.impute(df, fill).select("work_id", "recommended_amount", "final_amount"), "recommended_amount")


@query(oracle("SELECT feature FROM (SELECT feature, var_samp(value) AS v FROM long_feats GROUP BY feature UNION ALL SELECT 'constant', var_samp(1.0) FROM filled) WHERE v = 0 OR v IS NULL"))
def flat_features(spark, sf):
    df = analysed_works(spark, sf).withColumn("constant", F.lit(1.0))
    return quality.flat_features(df, [*matrix.FEATURES, "constant"])


@query(oracle("SELECT feature_1, feature_2, " + r("r") + " AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM filled"
    for i, a in enumerate(FEATURE_LIST) for b in FEATURE_LIST[i + 1:]) + ") WHERE abs(r) >= 0.85"))
def correlated_features(spark, sf):
    return tidy(quality.correlated_pairs(analysed_works(spark, sf), list(matrix.FEATURES)), "r")


@query(oracle("SELECT 1::bigint AS non_numeric_columns, ((count(*) - count(recommended_amount)) + (count(*) - count(final_amount)))::bigint AS null_cells, 0::bigint AS infinite_cells FROM works"))
def preflight_counts(spark, sf):
    return quality.preflight(works(spark, sf), ["recommended_amount", "final_amount", "state"])


@query(oracle(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM payments" for c in ("vendor", "mp_name", "constituency", "ida", "work_description"))))
def distinct_entities(spark, sf):
    return quality.distinct_counts(payments(spark, sf), ["vendor", "mp_name", "constituency", "ida", "work_description"])


@query(oracle("SELECT project_status, count(*) AS rows FROM works GROUP BY ALL"))
def status_split(spark, sf):
    return works(spark, sf).groupBy("project_status").agg(F.count(F.lit(1)).alias("rows"))


# Projections, joins and sets on the raw views.


@query(oracle("SELECT mp_name, constituency, state, work_description, vendor, ida, expenditure_amount, expenditure_date, payment_status FROM payments_raw"))
def canonical_names(spark, sf):
    return clean.canonical(raw(spark, sf, "payments_raw"), clean.PAYMENT_TITLES)


@query(oracle("SELECT DISTINCT * FROM payments_raw"))
def distinct_rows(spark, sf):
    return clean.canonical(raw(spark, sf, "payments_raw"), clean.PAYMENT_TITLES).distinct()


@query(oracle("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Promotion' WHEN 'LARGE' THEN 'Big' ELSE p_type END AS kind FROM part"))
def value_mapping(spark, sf):
    kind = scalars.recode(F.col("p_type"), {"PROMO": "Promotion", "LARGE": "Big"})
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind"))


@query(oracle("SELECT w.work_id, " + r("s.total_expenditure / nullif(s.allocated_amount, 0)") + " AS release_ratio FROM works w LEFT JOIN sponsors s ON w.mp_name = s.mp_name AND w.constituency = s.constituency"))
def release_ratio_join(spark, sf):
    return tidy(with_release_ratio(works(spark, sf), sponsors(spark, sf)).select("work_id", "release_ratio"), "release_ratio")


@query(oracle("SELECT w.work_id, s.completed_works_count, s.recommended_works_count, " + r("s.completion_rate_pct") + " AS completion_rate_pct FROM works w LEFT JOIN sponsors s ON w.mp_name = s.mp_name AND w.constituency = s.constituency"))
def sponsor_metrics_join(spark, sf):
    from worklens.plans.risk import with_sponsor_metrics

    df = with_sponsor_metrics(works(spark, sf), sponsors(spark, sf))
    return tidy(df.select("work_id", "completed_works_count", "recommended_works_count", "completion_rate_pct"), "completion_rate_pct")


_COHORT = "constituency_max_vendor_share constituency_avg_vendor_transaction"


@query(oracle(sql_tidy("""(SELECT w.work_id, constituency_max_vendor_share, constituency_avg_vendor_transaction, constituency_vendor_count
    FROM works w LEFT JOIN vend_cohort v ON coalesce(upper(trim(w.state)), 'NAN') = v.clean_state
    AND coalesce(upper(trim(w.constituency)), 'NAN') = v.clean_const)""", _COHORT)))
def normalised_key_join(spark, sf):
    vendors = vendor.vendor_features(settled_payments(spark, sf), P)
    padded = works(spark, sf).withColumn("state", F.concat(F.lit(" "), F.lower("state"), F.lit(" ")))
    df = vendor.with_vendor_cohort(padded, vendors)
    return tidy(df.select("work_id", *_COHORT.split(), "constituency_vendor_count"), _COHORT)


@query(oracle("SELECT mp_name, constituency, expenditure_year FROM payment_year"))
def usual_payment_year(spark, sf):
    return temporal.usual_payment_year(payments(spark, sf))


@query(oracle(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(sum({dec('l_extendedprice')}) OVER (PARTITION BY l_suppkey) AS double) AS supplier_total FROM lineitem"))
def group_total_lookup(spark, sf):
    df = cohorts.with_group_total(table(spark, sf, "lineitem"), "l_suppkey", scalars.exact_sum(F.col("l_extendedprice")), "supplier_total")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "supplier_total")


@query(oracle("SELECT vendor, transaction_count, pending_count, success_count, total_vendor_expenditure, average_vendor_transaction FROM vend_stats"))
def vendor_rollup(spark, sf):
    return vendor.vendor_totals(payments(spark, sf))


@query(oracle("SELECT vendor, (transaction_count - 1)::double / transaction_count AS vendor_repeat_rate, pending_count::double / transaction_count AS pending_payment_ratio, success_count::double / transaction_count AS payment_status_distribution FROM vend_stats"))
def vendor_ratios(spark, sf):
    df = vendor.with_vendor_ratios(vendor.vendor_totals(payments(spark, sf)))
    return df.select("vendor", "vendor_repeat_rate", "pending_payment_ratio", "payment_status_distribution")


@query(oracle("SELECT c.vendor, c.share AS constituency_share, m.share AS sponsor_share FROM vend_const c JOIN vend_sponsor m USING (vendor)"))
def vendor_largest_shares(spark, sf):
    rows = payments(spark, sf)
    return vendor.largest_share(rows, "constituency", "constituency_share").join(vendor.largest_share(rows, "mp_name", "sponsor_share"), "vendor")


@query(oracle("SELECT vendor, active_months AS active_months_count FROM vend_stats"))
def vendor_active_months(spark, sf):
    return vendor.active_months(payments(spark, sf))


@query(oracle("SELECT vendor, " + r("(y1 - y0) / nullif(y0, 0) * 100") + " AS change FROM vend_stats"))
def vendor_year_change(spark, sf):
    df = temporal.year_change(payments(spark, sf), ["vendor"], "expenditure_year", P.payment_years, "change", F.col("expenditure_amount"))
    return tidy(df, "change")


@query(oracle("SELECT state, " + r("year_over_year_change") + " AS year_over_year_change FROM state_change"))
def state_year_change(spark, sf):
    return tidy(temporal.year_change(works(spark, sf), ["state"], "recommendation_year", P.works_years, "year_over_year_change"), "year_over_year_change")


@query(oracle("SELECT vendor, NULL::double AS change FROM vend_stats"))
def year_change_without_year(spark, sf):
    """A year that the data lacks makes every change unknown."""
    return temporal.year_change(payments(spark, sf), ["vendor"], "expenditure_year", (2001, 2040), "change", F.col("expenditure_amount"))


@query(oracle("SELECT vendor, state, constituency, mp_name, ida FROM vend_first"))
def vendor_first_seen(spark, sf):
    return vendor.first_seen(payments(spark, sf), ["state", "constituency", "mp_name", "ida"])


# Window-like operators, built from aggregates and joins.


@query(oracle(f"SELECT work_id, {r(_p('effective_amount', 'constituency'))} AS pct FROM amounts"))
def percentile_in_group(spark, sf):
    df = with_effective_amount(settled_works(spark, sf))
    return tidy(cohorts.with_percentile(df, "constituency", "effective_amount", "pct", P.min_group).select("work_id", "pct"), "pct")


@query(oracle(f"SELECT work_id, {r(_z('final_amount', 'category'))} AS z FROM works"))
def z_score_in_group(spark, sf):
    return tidy(cohorts.with_z_score(works(spark, sf), "category", "final_amount", "z", P).select("work_id", "z"), "z")


@query(oracle(f"SELECT work_id, {r(f'recommended_amount / (cast(sum({dec('recommended_amount')}) OVER (PARTITION BY state) AS double) / count(recommended_amount) OVER (PARTITION BY state))')} AS ratio FROM works"))
def ratio_to_group_mean(spark, sf):
    return tidy(cohorts.with_ratio_to_mean(works(spark, sf), "state", "recommended_amount", "ratio").select("work_id", "ratio"), "ratio")


@query(oracle("SELECT work_id, " + r("duration_deviation_from_historical_baseline") + " AS duration_deviation FROM tmp"))
def duration_z_score(spark, sf):
    df = temporal.with_temporal(settled_works(spark, sf), settled_payments(spark, sf), P)
    return tidy(df.select("work_id", F.col("duration_deviation_from_historical_baseline").alias("duration_deviation")), "duration_deviation")


@query(oracle("SELECT work_id, CASE WHEN final_amount IS NOT NULL AND category IS NOT NULL THEN count(final_amount) OVER (PARTITION BY category) END AS group_size FROM works"))
def group_size_gate(spark, sf):
    return cohorts.with_group_size(works(spark, sf), "category", "final_amount", "group_size").select("work_id", "group_size")


@query(oracle(f"SELECT work_id, {r('(effective_amount - lo) / (hi - lo)')} AS scaled FROM amounts, (SELECT min(effective_amount) AS lo, max(effective_amount) AS hi FROM amounts)"))
def min_max_scaling(spark, sf):
    df = with_effective_amount(settled_works(spark, sf))
    return cohorts.with_min_max_scaled(df, "effective_amount", "scaled").select("work_id", "scaled")


# Scalar functions.


@query(oracle(f"SELECT work_id, {num('recommended_amount')} AS amount, coalesce({num('ida')}, 0)::double AS bad_as_zero FROM recommended_raw"))
def currency_text(spark, sf):
    rows = view(spark, sf, "recommended_raw")
    return rows.select("work_id", scalars.money(F.col("recommended_amount")).alias("amount"), scalars.money(F.col("ida"), missing=0.0).alias("bad_as_zero"))


@query(oracle("""
    SELECT work_id, strftime(recommendation_date::timestamp, '%Y-%m-%d') AS day, year(recommendation_date::timestamp) AS year,
           month(recommendation_date::timestamp) AS month, strftime(recommendation_date::timestamp, '%Y-%m') AS year_month,
           strftime(recommendation_date::timestamp - INTERVAL 330 MINUTE, '%Y-%m-%d') AS utc_day, NULL::varchar AS bad FROM recommended_raw"""))
def date_text(spark, sf):
    rows = view(spark, sf, "recommended_raw")
    day = scalars.iso_date(F.col("recommendation_date"))
    zoned = scalars.iso_date(F.concat("recommendation_date", F.lit("+05:30")))
    return rows.select(
        "work_id", scalars.iso_text(day).alias("day"), F.year(day).alias("year"), F.month(day).alias("month"),
        F.date_format(day, "yyyy-MM").alias("year_month"), scalars.iso_text(zoned).alias("utc_day"),
        scalars.iso_text(scalars.iso_date(F.col("ida"))).alias("bad"),
    )


@query(oracle("""
    SELECT work_id, delay, """ + r("delay / 30.4375::double") + """ AS months, coalesce(completed_date < recommendation_date, false) AS impossible,
           coalesce(delay < 0, false) AS negative, coalesce(coalesce(recommendation_year, completed_year) IN (1998, 1999), false) AS in_window FROM delays"""))
def date_differences(spark, sf):
    df = temporal.with_calendar(works(spark, sf), P)
    return df.select(
        "work_id", F.col("completion_delay_days").alias("delay"), scalars.rounded(F.col("completion_delay_months"), 6).alias("months"),
        (F.col("is_impossible_date_sequence") == 1).alias("impossible"), (F.col("is_negative_duration") == 1).alias("negative"),
        (F.col("is_covid_era") == 1).alias("in_window"),
    )


@query(oracle(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, least(greatest(l_extendedprice, 20000), 60000) AS clipped, {r("l_extendedprice / l_quantity", 2)} AS unit_price,
           format('{{:,.2f}}', l_extendedprice) AS grouped, printf('%.1f', l_extendedprice / 1000) AS short,
           (l_discount > 0.05)::int AS discounted, l_extendedprice / nullif(l_tax, 0) AS per_tax FROM lineitem"""))
def number_functions(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", scalars.clip(price, 20000.0, 60000.0).alias("clipped"),
        scalars.rounded(scalars.ratio(price, F.col("l_quantity")), 2).alias("unit_price"), scalars.grouped(price, 2).alias("grouped"),
        scalars.fixed(price / 1000, 1).alias("short"), scalars.flag(F.col("l_discount") > 0.05).alias("discounted"),
        scalars.ratio(price, F.col("l_tax")).alias("per_tax"),
    )


@query(oracle("SELECT doc_id, sha256(text) AS sha256, upper(trim(source)) AS place, coalesce(lang, 'UNKNOWN_STATE') || '___' || coalesce(source, 'UNKNOWN_CONST') AS block FROM documents"))
def text_keys(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), scalars.place_key(F.col("source")).alias("place"),
        scalars.block_key(F.col("lang"), F.col("source")).alias("block"),
    )


@query(oracle("SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 2) ELSE substr(text, 1, 100) END AS headline FROM documents"))
def second_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.headline(F.col("text")).alias("headline"))
