"""Registered queries over the master table: roll-ups, explorer, lookups, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import P, master, scored_works, settled_works
from catalog.oracles import STEPS, money_avg, money_sum, oracle, r
from catalog.registry import query
from worklens.functions.scalars import headline
from worklens.operators import explorer, quality
from worklens.plans import areas, baselines, evaluate
from worklens.sources import io

_COUNTS = """count(work_id) AS total_works, count(*) FILTER (WHERE risk_category = 'HIGH') AS high_risk_works,
    count(*) FILTER (WHERE risk_category = 'MEDIUM') AS {m}_risk_works, count(*) FILTER (WHERE risk_category = 'LOW') AS low_risk_works,
    quantile_cont(final_risk_score, 0.5) AS median_risk_score"""
_SIGNALS = """count(*) FILTER (WHERE cost_z_score > 2.5) AS high_z_count,
    count(*) FILTER (WHERE nearest_similarity_score >= 0.85) AS high_sim_count,
    count(*) FILTER (WHERE isolation_forest_score >= 55) AS high_iso_count,
    count(*) FILTER (WHERE is_impossible_date_sequence = 1) AS imp_date_count"""


def _status(k: int) -> str:
    return f"""CASE WHEN total_works < 5 THEN 'INSUFFICIENT DATA'
        WHEN area_risk_score >= 50 OR high_risk_pct >= 10 OR high_risk_works >= {k} THEN 'HIGH'
        WHEN area_risk_score >= 40 OR high_risk_pct >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS area_status"""


_DERIVED = f"""{r("high_risk_works::double / total_works * 100", 2)} AS high_risk_pct, {r("median_risk_score", 1)} AS area_risk_score"""
STEPS["states0"] = f"""
    SELECT state, {_COUNTS.format(m="med")}, {r(money_avg("final_risk_score"))} AS avg_risk_score,
           {money_sum("effective_amount")} AS total_amount FROM master WHERE state IS NOT NULL GROUP BY state"""
STEPS["states"] = f"SELECT *, {_status(10)} FROM (SELECT *, {_DERIVED} FROM states0)"
STEPS["consts0"] = f"""
    SELECT state, constituency, {_COUNTS.format(m="medium")}, {_SIGNALS} FROM master GROUP BY state, constituency"""
STEPS["consts"] = f"SELECT *, {_status(5)} FROM (SELECT *, {_DERIVED} FROM consts0)"


@query(oracle("SELECT * FROM states"))
def state_risk_map(spark, sf):
    return areas.state_rollup(master(spark, sf), P)


@query(oracle("SELECT * FROM consts"))
def constituency_risk_map(spark, sf):
    return areas.constituency_rollup(master(spark, sf), P)


@query(oracle("SELECT *, rank() OVER (PARTITION BY state ORDER BY area_risk_score DESC) AS rank_in_state FROM consts"))
def ranked_areas_in_state(spark, sf):
    return areas.rank_in_state(areas.constituency_rollup(master(spark, sf), P))


@query(oracle(f"""
    SELECT *, {r("100.0::double * high_risk_count / total_projects", 2)} AS high_risk_pct,
           {r("100.0::double * medium_risk_count / total_projects", 2)} AS medium_risk_pct,
           {r("100.0::double * low_risk_count / total_projects", 2)} AS low_risk_pct
    FROM (SELECT count(*) AS total_projects, count(*) FILTER (WHERE risk_category = 'HIGH') AS high_risk_count,
                 count(*) FILTER (WHERE risk_category = 'MEDIUM') AS medium_risk_count,
                 count(*) FILTER (WHERE risk_category = 'LOW') AS low_risk_count,
                 {r(money_avg("final_risk_score"), 2)} AS average_risk_score,
                 {money_sum("effective_amount")} AS total_effective_amount FROM master)"""))
def risk_overview(spark, sf):
    return areas.overview(master(spark, sf))


@query(oracle(f"""
    SELECT state, {r("quantile_cont(final_risk_score, 0.5)", 1)} AS median_risk_score FROM master GROUP BY state
    ORDER BY 2 DESC, state LIMIT 10"""))
def top_states_by_median(spark, sf):
    return areas.top_states(master(spark, sf))


@query(oracle("""
    SELECT sum(a) AS total_allocated, sum(e) AS total_mp_expenditure, sum(w)::bigint AS total_completed_works FROM (
        SELECT mp_name, cast(max(mp_allocated_amount) AS decimal(18,2)) AS a, cast(max(mp_total_expenditure) AS decimal(18,2)) AS e,
               max(mp_completed_works) AS w FROM master GROUP BY mp_name)"""))
def sponsor_totals_once(spark, sf):
    return areas.sponsor_totals(master(spark, sf))


@query(oracle("SELECT state, count(*) AS high_risk_count FROM master WHERE risk_category = 'HIGH' GROUP BY state ORDER BY 2 DESC, 1 LIMIT 10"))
def high_risk_works_by_state(spark, sf):
    return areas.high_risk_by_state(master(spark, sf))


def _shares(col: str, source: str) -> str:
    return f"""SELECT {col}, count(*) AS rows, {r("100.0::double * count(*) / sum(count(*)) OVER ()", 2)} AS share_pct
        FROM {source} WHERE {col} IS NOT NULL GROUP BY {col}"""


@query(oracle(_shares("risk_category", "master")))
def risk_category_counts(spark, sf):
    return areas.category_counts(master(spark, sf))


@query(oracle(_shares("area_status", "consts")))
def area_status_counts(spark, sf):
    return quality.value_shares(areas.constituency_rollup(master(spark, sf), P), "area_status")


@query(oracle("""
    SELECT state, """ + _SIGNALS + """, """ + money_sum("effective_amount") + """ AS total_amount,
      coalesce(nullif(concat_ws(chr(10),
        CASE WHEN high_z_count > 0 THEN '• ' || high_z_count || ' project(s) exhibit unusually high cost compared with historical benchmarks (Z-Score > 2.5).' END,
        CASE WHEN high_sim_count > 0 THEN '• ' || high_sim_count || ' project(s) show high description text similarity (>= 85% cosine match) with existing works.' END,
        CASE WHEN high_iso_count > 0 THEN '• ' || high_iso_count || ' project(s) exhibit multi-dimensional feature isolation flagged by Isolation Forest.' END,
        CASE WHEN imp_date_count > 0 THEN '• ' || imp_date_count || ' project(s) contain invalid date chronology sequences.' END), ''),
        '• All projects in this state operate within standard baseline bounds.') AS signals
    FROM master WHERE state IS NOT NULL GROUP BY state"""))
def state_signals(spark, sf):
    return areas.state_signals(master(spark, sf), P)


@query(oracle("""
    SELECT state, constituency, coalesce(nullif(concat_ws(chr(10),
        CASE WHEN high_z_count > 0 THEN '• ' || high_z_count || ' project(s) exhibit unusually high cost compared with historical benchmarks.' END,
        CASE WHEN high_sim_count > 0 THEN '• ' || high_sim_count || ' project(s) show high text similarity (>= 85%) with existing descriptions.' END,
        CASE WHEN high_iso_count > 0 THEN '• ' || high_iso_count || ' project(s) exhibit unusual feature isolation patterns.' END,
        CASE WHEN imp_date_count > 0 THEN '• ' || imp_date_count || ' project(s) contain invalid date chronology flags.' END), ''),
        '• All projects in this constituency operate within standard baseline bounds.') AS signals FROM consts"""))
def constituency_signals(spark, sf):
    return areas.constituency_signals(areas.constituency_rollup(master(spark, sf), P)).select("state", "constituency", "signals")


@query(oracle("""
    SELECT state, constituency, CASE WHEN area_risk_score < 40 THEN 'Low (0-39)' WHEN area_risk_score < 55 THEN 'Moderate (40-54)'
           WHEN area_risk_score < 70 THEN 'Elevated (55-69)' ELSE 'High (70-100)' END AS band FROM consts"""))
def area_score_bands(spark, sf):
    rows = areas.constituency_rollup(master(spark, sf), P)
    return rows.select("state", "constituency", areas.score_band(F.col("area_risk_score")).alias("band"))


@query(oracle("""
    SELECT baseline_group, count(work_id) AS project_count, max(group_median) AS median_expenditure,
           max(group_mean) AS mean_expenditure, max(group_p99) AS p99_ceiling
    FROM master GROUP BY baseline_group ORDER BY project_count DESC, baseline_group LIMIT 15"""))
def largest_cohorts(spark, sf):
    return baselines.cohort_summary(master(spark, sf))


@query(oracle("""
    SELECT work_id, baseline_group, unnest(['Project Value', 'Cohort Median (P50)', 'Cohort Mean', 'Cohort 99th Percentile (P99)']) AS measure,
           unnest([effective_amount, group_median, group_mean, group_p99]) AS amount FROM master"""))
def benchmark_comparison(spark, sf):
    return explorer.benchmark_comparison(master(spark, sf))


# Filters and lookups. Parameters are the ones a reader of the explorer would choose.


@query(oracle("SELECT work_id, state, category, risk_category FROM master WHERE state = 'NATION_3' AND category = 'PROMO' AND risk_category = 'MEDIUM'"))
def explorer_equality_filters(spark, sf):
    wanted = {"state": "NATION_3", "constituency": None, "category": "PROMO", "risk_category": "MEDIUM"}
    return explorer.where_equal(master(spark, sf), wanted).select("work_id", "state", "category", "risk_category")


@query(oracle("""
    SELECT work_id, state, category, recommendation_year, project_status FROM master WHERE state IN ('NATION_1', 'NATION_2', 'NATION_7')
      AND category IN ('PROMO', 'SMALL') AND recommendation_year IN (1999, 2000) AND project_status IN ('Recommended & Completed')"""))
def explorer_list_filters(spark, sf):
    wanted = {
        "state": ["NATION_1", "NATION_2", "NATION_7"], "constituency": [], "category": ["PROMO", "SMALL"],
        "recommendation_year": [1999, 2000], "project_status": ["Recommended & Completed"],
    }
    return explorer.where_in(master(spark, sf), wanted).select("work_id", "state", "category", "recommendation_year", "project_status")


@query(oracle("""
    SELECT work_id, mp_name, work_description FROM master WHERE contains(lower(work_id::varchar), 'gizmo')
       OR contains(lower(mp_name), 'gizmo') OR contains(lower(work_description), 'gizmo')"""))
def explorer_search(spark, sf):
    return explorer.search(master(spark, sf), " Gizmo ", ["work_id", "mp_name", "work_description"]).select("work_id", "mp_name", "work_description")


@query(oracle("SELECT work_id, category FROM works WHERE final_amount IS NOT NULL AND category IS NULL"))
def missing_category_of_completed(spark, sf):
    from catalog.inputs import works

    return works(spark, sf).where(F.col("final_amount").isNotNull() & F.col("category").isNull()).select("work_id", "category")


@query(oracle("SELECT DISTINCT constituency FROM master WHERE state IN ('NATION_3', 'NATION_4')"))
def cascading_filter_options(spark, sf):
    return explorer.options(master(spark, sf), "constituency", {"state": ["NATION_3", "NATION_4"]})


@query(oracle("SELECT work_id, final_risk_score, risk_category FROM master WHERE state = 'NATION_5' ORDER BY final_risk_score DESC, work_id LIMIT 50 OFFSET 50"))
def explorer_page(spark, sf):
    _, rows = explorer.project_explorer(master(spark, sf), equal={"state": "NATION_5"}, limit=50, offset=50)
    return rows.select("work_id", "final_risk_score", "risk_category")


@query(oracle("SELECT count(*) AS total_records FROM master WHERE category IN ('LARGE') AND contains(lower(work_description), 'red')"))
def explorer_total(spark, sf):
    total, _ = explorer.project_explorer(master(spark, sf), among={"category": ["LARGE"]}, term="RED")
    return total


@query(oracle("SELECT * EXCLUDE (explanation, mp_utilization_pct, mp_completion_rate_pct, constituency_max_vendor_share, constituency_pending_payment_ratio) FROM master WHERE work_id = 1234"))
def work_by_id(spark, sf):
    rows = explorer.where_equal(master(spark, sf), {"work_id": 1234})
    return rows.drop("explanation", "mp_utilization_pct", "mp_completion_rate_pct", "constituency_max_vendor_share", "constituency_pending_payment_ratio")


@query(oracle("SELECT work_id, cost_z_score, state, effective_amount FROM master ORDER BY cost_z_score DESC, work_id LIMIT 5"))
def most_extreme_costs(spark, sf):
    return master(spark, sf).orderBy(F.desc("cost_z_score"), "work_id").limit(5).select("work_id", "cost_z_score", "state", "effective_amount")


@query(oracle("""
    SELECT state, rank, work_id, final_risk_score, CASE WHEN contains(explanation, chr(10)) THEN split_part(explanation, chr(10), 2)
           ELSE substr(explanation, 1, 100) END AS main_reason FROM (
        SELECT *, row_number() OVER (PARTITION BY state ORDER BY final_risk_score DESC, work_id) AS rank FROM master) WHERE rank <= 10"""))
def top_flagged_works_per_state(spark, sf):
    top = explorer.top_per_group(master(spark, sf), "state", "final_risk_score", "work_id", 10)
    return top.select("state", "rank", "work_id", "final_risk_score", headline(F.col("explanation")).alias("main_reason"))


@query(oracle(f"""
    SELECT least(floor((final_risk_score - lo) / ((hi - lo) / 40)), 39)::int AS bin, risk_category, count(*) AS rows
    FROM master, (SELECT min(final_risk_score) AS lo, max(final_risk_score) AS hi FROM master) GROUP BY ALL"""))
def risk_score_histogram(spark, sf):
    return evaluate.histogram(master(spark, sf), "final_risk_score", 40, ["risk_category"])


@query(oracle("""
    SELECT '{"work_id":' || work_id || ',"state":"' || state || '","total_works":' || n || '}' AS record
    FROM (SELECT state, count(*) AS n, min(work_id) AS work_id FROM master GROUP BY state)"""))
def records_as_json(spark, sf):
    rows = master(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("total_works"), F.min("work_id").alias("work_id"))
    return io.as_json(rows, "work_id", "state", "total_works")


@query(oracle("""
    SELECT n_name AS state, CASE n_name WHEN 'NATION_1' THEN 'Region One' ELSE n_name END AS region, total_works, area_risk_score
    FROM nation LEFT JOIN states ON n_name = state"""))
def map_regions_with_scores(spark, sf):
    """Regions of a map file written from the nations, with one name that differs, joined to state scores."""
    import os

    from catalog.views import table
    from worklens.sources.staging import stage_root

    names = {"NATION_1": "Region One"}
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("state"))
    path = os.path.join(stage_root(spark), "regions.json")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(areas.recode(F.col("state"), names).alias("st_nm")).alias("properties"))
    nations.agg(F.collect_list(feature).alias("features")).write.mode("overwrite").json(path)
    found = io.regions_with_scores(io.read_regions(spark, path), areas.state_rollup(master(spark, sf), P), names)
    back = F.when(F.col("region") == "Region One", "NATION_1").otherwise(F.col("region"))
    return found.select(back.alias("state"), "region", "total_works", "area_risk_score")


@query(oracle("""
    SELECT work_id, s.sev AS normalized_anomaly_score, m.final_risk_score, m.risk_category, w.category
    FROM scores s JOIN master m USING (work_id) LEFT JOIN works w USING (work_id)"""))
def results_joined_to_scores(spark, sf):
    scores = scored_works(spark, sf).select("work_id", "normalized_anomaly_score")
    risk = master(spark, sf).select("work_id", "final_risk_score", "risk_category")
    kinds = settled_works(spark, sf).select("work_id", "category")
    return scores.join(risk, "work_id").join(kinds, "work_id", "left")


@query(oracle("SELECT work_id, risk_category, 'scored' AS part FROM master WHERE risk_category = 'HIGH' UNION ALL SELECT work_id, risk_category, 'rest' FROM master WHERE risk_category <> 'HIGH'"))
def union_of_result_parts(spark, sf):
    rows = master(spark, sf).select("risk_category", "work_id")
    high = rows.where("risk_category = 'HIGH'").withColumn("part", F.lit("scored"))
    rest = rows.where("risk_category <> 'HIGH'").withColumn("part", F.lit("rest")).select("part", "work_id", "risk_category")
    return high.unionByName(rest)


@query(oracle("SELECT work_id, mp_name, state, final_risk_score FROM master"))
def available_columns_only(spark, sf):
    wanted = ["work_id", "mp_name", "no_such_column", "state", "final_risk_score"]
    return explorer.existing(master(spark, sf).drop("no_such_column"), wanted)
