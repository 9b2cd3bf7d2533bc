"""The same computations in plain SQL, written independently of the Spark code, as named steps."""

from __future__ import annotations

from catalog.views import VIEWS, with_ctes


def r(expr: str, places: int = 6) -> str:
    return f"(round_even(({expr}) * 1e{places}, 0) / 1e{places})"


def num(text: str) -> str:
    return f"try_cast(trim(replace(replace({text}, '₹', ''), ',', '')) AS double)"


def dec(col: str) -> str:
    return f"cast({col} AS decimal(18,2))"


def money_avg(col: str) -> str:
    return f"cast(sum({dec(col)}) AS double) / count({col})"


def money_sum(col: str) -> str:
    return f"cast(sum({dec(col)}) AS double)"


def quantile(col: str, p: float) -> str:
    """Linear interpolation over the sorted values, spelled out."""
    s = f"list_sort(list({col}) FILTER (WHERE {col} IS NOT NULL))"
    at = f"((count({col}) - 1) * {p!r}::double)"
    lo = f"{s}[cast(floor({at}) AS bigint) + 1]"
    hi = f"{s}[cast(ceil({at}) AS bigint) + 1]"
    return f"({lo} + ({hi} - {lo}) * ({at} - floor({at})))"


def pct_rank(value: str, group: str) -> str:
    """Average-tie percentile rank over a group; the caller masks missing values and groups."""
    return (
        f"((rank() OVER (PARTITION BY {group} ORDER BY {value} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {group}, {value}) - 1) / 2.0::double) "
        f"/ count({value}) OVER (PARTITION BY {group}) * 100.0::double)"
    )


STEPS: dict[str, str] = dict(VIEWS)


def oracle(select: str) -> str:
    return with_ctes(select, STEPS)


STEPS["payments"] = f"""
    SELECT mp_name, constituency, state, work_description, vendor, ida, {num("expenditure_amount")} AS expenditure_amount,
           expenditure_date, payment_status, strftime(cast(expenditure_date AS timestamp), '%Y-%m-%d') AS expenditure_date_iso,
           year(cast(expenditure_date AS timestamp)) AS expenditure_year,
           coalesce(year(cast(expenditure_date AS timestamp)) IN (1998, 1999), false) AS is_covid_era
    FROM (SELECT DISTINCT * FROM payments_raw)"""

STEPS["works"] = f"""
    SELECT coalesce(c.work_id, o.work_id) AS work_id,
           CASE WHEN c.work_id IS NULL THEN 'Recommended' WHEN o.work_id IS NULL THEN 'Completed'
                ELSE 'Recommended & Completed' END AS project_status,
           coalesce(c.work_description, o.work_description) AS work_description, c.category,
           coalesce(c.mp_name, o.mp_name) AS mp_name, coalesce(c.constituency, o.constituency) AS constituency,
           coalesce(c.state, o.state) AS state, coalesce(c.ida, o.ida) AS ida,
           {num("o.recommended_amount")} AS recommended_amount, {num("c.final_amount")} AS final_amount,
           substr(o.recommendation_date, 1, 10) AS recommendation_date, substr(c.completed_date, 1, 10) AS completed_date,
           cast(substr(o.recommendation_date, 1, 4) AS int) AS recommendation_year,
           cast(substr(c.completed_date, 1, 4) AS int) AS completed_year,
           coalesce(c.has_images, o.has_images) AS has_images, c.average_rating,
           coalesce(cast(substr(coalesce(c.completed_date, o.recommendation_date), 1, 4) AS int) IN (1998, 1999), false) AS is_covid_era
    FROM recommended_raw o FULL JOIN completed_raw c ON o.work_id = c.work_id"""

STEPS["sponsors"] = f"""
    SELECT * REPLACE ({num("allocated_amount")} AS allocated_amount, {num("total_expenditure")} AS total_expenditure,
                      {num("unspent_amount")} AS unspent_amount) FROM sponsor_raw"""


def _z(value: str, group: str, n: str = "") -> str:
    w = f"OVER (PARTITION BY {group})"
    return (
        f"CASE WHEN {group} IS NOT NULL AND count({value}) {w} >= 10 AND stddev_samp({value}) {w} > 1e-6 "
        f"THEN ({value} - cast(sum({dec(value)}) {w} AS double) / count({value}) {w}) / stddev_samp({value}) {w} END"
    )


def _p(value: str, group: str, least: int = 10) -> str:
    return (
        f"CASE WHEN {group} IS NOT NULL AND {value} IS NOT NULL AND count({value}) OVER (PARTITION BY {group}) >= {least} "
        f"THEN {pct_rank(value, group)} END"
    )


STEPS["amounts"] = "SELECT *, coalesce(final_amount, recommended_amount) AS effective_amount FROM works"

STEPS["fin"] = f"""
    SELECT a.work_id, project_status, a.state, a.constituency, category, effective_amount, recommended_amount, final_amount,
           final_amount / nullif(recommended_amount, 0) AS expenditure_ratio,
           recommended_amount - final_amount AS unspent_balance,
           recommended_amount / (cast(sum({dec("recommended_amount")}) OVER (PARTITION BY a.state) AS double)
               / count(recommended_amount) OVER (PARTITION BY a.state)) AS recommendation_sanction_ratio,
           {_z("final_amount", "category")} AS expenditure_deviation,
           {_z("effective_amount", "a.state")} AS cost_deviation,
           {_p("effective_amount", "category")} AS cost_percentile,
           {_p("effective_amount", "a.state")} AS state_cost_percentile,
           {_p("effective_amount", "a.constituency")} AS constituency_cost_percentile,
           s.total_expenditure / nullif(s.allocated_amount, 0) AS release_ratio
    FROM amounts a LEFT JOIN sponsors s ON a.mp_name = s.mp_name AND a.constituency = s.constituency"""

STEPS["delays"] = """
    SELECT *, date_diff('day', cast(recommendation_date AS date), cast(completed_date AS date)) AS delay FROM works"""

STEPS["state_change"] = """
    SELECT state, 100.0::double * (count(*) FILTER (WHERE recommendation_year = 2000)
           - count(*) FILTER (WHERE recommendation_year = 1999))
           / nullif(count(*) FILTER (WHERE recommendation_year = 1999), 0) AS year_over_year_change
    FROM works WHERE recommendation_year IS NOT NULL GROUP BY state"""

STEPS["payment_year"] = """
    SELECT mp_name, constituency, quantile_cont(expenditure_year, 0.5) AS expenditure_year
    FROM payments GROUP BY mp_name, constituency"""

STEPS["tmp"] = """
    SELECT d.work_id, project_status, d.state, d.constituency, category, recommendation_year,
           month(cast(recommendation_date AS date)) AS recommendation_month, y.expenditure_year,
           cast(NULL AS int) AS expenditure_month, delay AS completion_delay_days,
           delay / 30.4375::double AS completion_delay_months, delay AS project_duration_days,
           delay / 30.4375::double AS project_duration_months, cast(NULL AS int) AS recommendation_to_start_days,
           cast(coalesce(completed_date < recommendation_date, false) AS int) AS is_impossible_date_sequence,
           cast(coalesce(delay < 0, false) AS int) AS is_negative_duration,
           cast(coalesce(coalesce(recommendation_year, completed_year) IN (1998, 1999), false) AS int) AS is_covid_era,
           CASE WHEN count(d.work_id) OVER s >= 10 AND stddev_samp(CASE WHEN delay >= 0 THEN delay END) OVER s > 1e-6
                THEN (CASE WHEN delay >= 0 THEN delay END - avg(CASE WHEN delay >= 0 THEN delay END) OVER s)
                     / stddev_samp(CASE WHEN delay >= 0 THEN delay END) OVER s
           END AS duration_deviation_from_historical_baseline,
           c.year_over_year_change
    FROM delays d LEFT JOIN state_change c ON d.state = c.state
         LEFT JOIN payment_year y ON d.mp_name = y.mp_name AND d.constituency = y.constituency
    WINDOW s AS (PARTITION BY d.state)"""

STEPS["vend_const"] = f"""
    SELECT vendor, max(part / whole) AS share FROM (
        SELECT vendor, constituency, {money_sum("expenditure_amount")} AS part FROM payments GROUP BY ALL) p
    JOIN (SELECT constituency, {money_sum("expenditure_amount")} AS whole FROM payments GROUP BY ALL) w
    USING (constituency) GROUP BY vendor"""

STEPS["vend_sponsor"] = f"""
    SELECT vendor, max(part / whole) AS share FROM (
        SELECT vendor, mp_name, {money_sum("expenditure_amount")} AS part FROM payments GROUP BY ALL) p
    JOIN (SELECT mp_name, {money_sum("expenditure_amount")} AS whole FROM payments GROUP BY ALL) w
    USING (mp_name) GROUP BY vendor"""

STEPS["vend_first"] = """
    SELECT vendor, state, constituency, mp_name, ida FROM (
        SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY expenditure_date_iso NULLS FIRST,
            expenditure_amount NULLS FIRST, state NULLS FIRST, constituency NULLS FIRST, mp_name NULLS FIRST,
            ida NULLS FIRST, work_description NULLS FIRST, payment_status NULLS FIRST) AS k FROM payments) WHERE k = 1"""

STEPS["vend_stats"] = f"""
    SELECT vendor, count(expenditure_amount) AS transaction_count, {money_sum("expenditure_amount")} AS total_vendor_expenditure,
           {money_avg("expenditure_amount")} AS average_vendor_transaction,
           {quantile("expenditure_amount", 0.5)} AS median_vendor_transaction,
           count(*) FILTER (WHERE payment_status <> 'Payment Success') AS pending_count,
           count(*) FILTER (WHERE payment_status = 'Payment Success') AS success_count,
           count(DISTINCT substr(expenditure_date_iso, 1, 7)) AS active_months,
           coalesce(sum({dec("expenditure_amount")}) FILTER (WHERE expenditure_year = 2000), 0)::double AS y0,
           coalesce(sum({dec("expenditure_amount")}) FILTER (WHERE expenditure_year = 2001), 0)::double AS y1
    FROM payments GROUP BY vendor"""

STEPS["vend"] = """
    SELECT f.vendor, f.state, f.constituency, f.mp_name, f.ida, transaction_count, total_vendor_expenditure,
           average_vendor_transaction, median_vendor_transaction,
           (transaction_count - 1)::double / transaction_count AS vendor_repeat_rate,
           pending_count::double / transaction_count AS pending_payment_ratio,
           success_count::double / transaction_count AS payment_status_distribution,
           c.share AS vendor_share_of_constituency_expenditure, m.share AS "vendor_share_of_MP_expenditure",
           transaction_count::double / active_months AS transaction_frequency,
           (y1 - y0) / nullif(y0, 0) * 100.0::double AS year_over_year_vendor_change
    FROM vend_first f JOIN vend_stats s USING (vendor) LEFT JOIN vend_const c USING (vendor)
         LEFT JOIN vend_sponsor m USING (vendor)"""

STEPS["vend_cohort"] = """
    SELECT coalesce(upper(trim(state)), 'NAN') AS clean_state, coalesce(upper(trim(constituency)), 'NAN') AS clean_const,
           max(vendor_share_of_constituency_expenditure) AS constituency_max_vendor_share,
           avg(average_vendor_transaction) AS constituency_avg_vendor_transaction,
           count(DISTINCT vendor) AS constituency_vendor_count,
           avg(vendor_repeat_rate) AS constituency_avg_vendor_repeat_rate,
           avg(pending_payment_ratio) AS constituency_pending_payment_ratio
    FROM vend GROUP BY ALL"""


def tidy(name: str, columns: str, places: int = 6, star: str = "*") -> str:
    """Select with the listed double columns rounded, to take out the last-digit noise of summing order."""
    return f"SELECT {star} REPLACE (" + ", ".join(f"{r(c, places)} AS {c}" for c in columns.split()) + f") FROM {name}"


def _text_steps(name: str, source: str) -> None:
    """Steps for TF-IDF and brute-force similarity over a table with work_id, state, constituency, work_description."""
    from worklens.functions.stopwords import ENGLISH

    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
    n = name
    STEPS[f"{n}_clean"] = f"""
        SELECT *, trim(regexp_replace(lower(coalesce(work_description, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS cleaned,
               coalesce(state, 'UNKNOWN_STATE') || '___' || coalesce(constituency, 'UNKNOWN_CONST') AS block
        FROM {source}"""
    STEPS[f"{n}_kept"] = f"""
        SELECT cleaned, list_filter(string_split(cleaned, ' '), lambda x: length(x) >= 2 AND NOT list_contains([{stop}], x)) AS ws
        FROM (SELECT DISTINCT cleaned FROM {n}_clean)"""
    STEPS[f"{n}_tf"] = f"""
        SELECT cleaned, term, count(*) AS tf FROM (
            SELECT cleaned, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term
            FROM {n}_kept) GROUP BY ALL"""
    STEPS[f"{n}_copies"] = f"SELECT cleaned, count(*) AS copies FROM {n}_clean GROUP BY ALL"
    STEPS[f"{n}_vocab"] = f"""
        SELECT term, sum(copies)::bigint AS df, sum(tf * copies)::bigint AS cf,
               ln((1.0::double + (SELECT count(*) FROM {n}_clean)) / (1.0::double + sum(copies))) + 1.0::double AS idf
        FROM {n}_tf JOIN {n}_copies USING (cleaned) GROUP BY term HAVING sum(copies) >= 2
        ORDER BY cf DESC, term LIMIT 10000"""
    STEPS[f"{n}_raw"] = f"SELECT cleaned, term, tf * idf AS raw FROM {n}_tf JOIN {n}_vocab USING (term)"
    STEPS[f"{n}_w"] = f"""
        SELECT cleaned, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY cleaned)) AS w FROM {n}_raw"""
    STEPS[f"{n}_stats"] = f"""
        SELECT cleaned, sum(w) / (SELECT count(*) FROM {n}_vocab) AS tfidf_mean, max(w) AS tfidf_max FROM {n}_w GROUP BY ALL"""
    STEPS[f"{n}_member"] = f"SELECT block, cleaned, count(*) AS copies, min(work_id) AS first_id FROM {n}_clean GROUP BY ALL"
    STEPS[f"{n}_bw"] = f"SELECT block, cleaned, term, w FROM {n}_member JOIN {n}_w USING (cleaned)"
    STEPS[f"{n}_named"] = f"SELECT cleaned, string_agg(term || ':' || tf, ',' ORDER BY term) AS vector FROM {n}_tf JOIN {n}_vocab USING (term) GROUP BY cleaned"
    STEPS[f"{n}_vector"] = f"""
        SELECT block, cleaned, vector, min(first_id) OVER g AS head, sum(copies) OVER g AS copies
        FROM {n}_member JOIN {n}_named USING (cleaned) WINDOW g AS (PARTITION BY block, vector)"""
    STEPS[f"{n}_sim"] = f"""
        SELECT a.block, a.cleaned AS c1, b.cleaned AS c2, sum(a.w * b.w) AS score
        FROM {n}_bw a JOIN {n}_bw b ON a.block = b.block AND a.term = b.term AND a.cleaned < b.cleaned GROUP BY ALL"""
    STEPS[f"{n}_both"] = f"""
        SELECT block, c1 AS me, c2 AS other, score FROM {n}_sim UNION ALL SELECT block, c2, c1, score FROM {n}_sim"""
    STEPS[f"{n}_match"] = f"""
        SELECT m.block, m.cleaned,
               CASE WHEN any_value(s.cleaned) IS NULL THEN 0.0 WHEN any_value(m.copies) > 1 THEN 1.0
                    ELSE coalesce(max(b.score), 0.0) END::double AS nearest,
               (CASE WHEN any_value(s.cleaned) IS NULL THEN 0 ELSE any_value(m.copies) - 1 END
                + coalesce(sum(o.copies) FILTER (WHERE b.score >= 0.85), 0))::int AS alike
        FROM {n}_member m LEFT JOIN {n}_stats s ON m.cleaned = s.cleaned
             LEFT JOIN {n}_both b ON m.block = b.block AND m.cleaned = b.me
             LEFT JOIN {n}_member o ON b.block = o.block AND b.other = o.cleaned
        GROUP BY m.block, m.cleaned"""
    STEPS[f"{n}_feats"] = f"""
        SELECT work_id, project_status, state, constituency, length(coalesce(work_description, ''))::int AS description_length,
               len(list_filter(regexp_split_to_array(coalesce(work_description, ''), '\\s+'), lambda x: x <> ''))::int AS word_count,
               coalesce(tfidf_mean, 0.0::double) AS tfidf_mean, coalesce(tfidf_max, 0.0::double) AS tfidf_max,
               nearest AS nearest_similarity_score, alike AS similar_project_count
        FROM {n}_clean LEFT JOIN {n}_stats USING (cleaned) LEFT JOIN {n}_match USING (block, cleaned)"""


_text_steps("doc", "texts")
_text_steps("wk", "works")


STEPS["cohorts"] = """
    SELECT *, CASE WHEN category IS NOT NULL AND count(*) OVER (PARTITION BY category) >= 10 THEN 'Category: ' || category
                   WHEN constituency IS NOT NULL AND count(*) OVER (PARTITION BY constituency) >= 10 THEN 'Constituency: ' || constituency
                   ELSE 'State: ' || coalesce(state, 'nan') END AS baseline_group
    FROM amounts"""

STEPS["bench"] = f"""
    SELECT baseline_group, count(*) AS group_rows, {money_avg("effective_amount")} AS group_mean,
           coalesce(stddev_samp(effective_amount), 0) AS group_std, {quantile("effective_amount", 0.5)} AS group_median,
           {quantile("effective_amount", 0.75)} AS group_p75, {quantile("effective_amount", 0.9)} AS group_p90,
           {quantile("effective_amount", 0.95)} AS group_p95, {quantile("effective_amount", 0.99)} AS group_p99
    FROM cohorts GROUP BY baseline_group"""

STEPS["base0"] = f"""
    SELECT c.work_id, project_status, state, constituency, category, effective_amount, baseline_group,
           split_part(baseline_group, ':', 1) AS baseline_type, group_mean, group_std, group_median, group_p75, group_p90,
           group_p95, group_p99,
           {r("coalesce((effective_amount - group_mean) / nullif(group_std, 0), 0)", 4)} AS z_score,
           CASE WHEN group_rows <= 1 THEN 50.0::double ELSE {r(pct_rank("effective_amount", "baseline_group"), 4)} END AS percentile
    FROM cohorts c JOIN bench USING (baseline_group)"""

STEPS["base"] = """
    SELECT *, (z_score > 2.5 OR percentile >= 95)::int AS statistical_flag, (z_score > 2.5)::int AS z_flag,
           (percentile >= 95)::int AS p95_flag, (percentile >= 99)::int AS p99_flag FROM base0"""

FEATURE_LIST = (
    "effective_amount cost_deviation state_cost_percentile constituency_cost_percentile release_ratio "
    "recommendation_sanction_ratio is_impossible_date_sequence is_negative_duration is_covid_era year_over_year_change "
    "description_length word_count tfidf_mean tfidf_max nearest_similarity_score similar_project_count "
    "constituency_max_vendor_share constituency_avg_vendor_transaction constituency_vendor_count "
    "constituency_avg_vendor_repeat_rate constituency_pending_payment_ratio"
).split()
_CONSTANT = {
    "recommendation_sanction_ratio": 1, "year_over_year_change": 0, "constituency_vendor_count": 0,
    "constituency_avg_vendor_repeat_rate": 0, "constituency_pending_payment_ratio": 0,
}
ACTIVE_LIST = [f for f in FEATURE_LIST if f not in ("is_negative_duration", "is_covid_era")]

STEPS["mat"] = """
    SELECT f.work_id, f.project_status, f.state, f.constituency, effective_amount, cost_deviation, state_cost_percentile,
           constituency_cost_percentile, release_ratio, recommendation_sanction_ratio, is_impossible_date_sequence,
           is_negative_duration, is_covid_era, year_over_year_change, description_length, word_count, tfidf_mean, tfidf_max,
           nearest_similarity_score, similar_project_count, constituency_max_vendor_share,
           constituency_avg_vendor_transaction, constituency_vendor_count, constituency_avg_vendor_repeat_rate,
           constituency_pending_payment_ratio
    FROM fin f JOIN tmp t USING (work_id) JOIN wk_feats x USING (work_id)
         LEFT JOIN vend_cohort v ON v.clean_state = coalesce(upper(trim(f.state)), 'NAN')
              AND v.clean_const = coalesce(upper(trim(f.constituency)), 'NAN')"""

STEPS["medians"] = "SELECT " + ", ".join(
    f"{quantile(c, 0.5)} AS {c}" for c in FEATURE_LIST if c not in _CONSTANT
) + " FROM mat"

STEPS["filled"] = "SELECT m.work_id, m.project_status, m.state, m.constituency, " + ", ".join(
    f"coalesce(m.{c}, {_CONSTANT[c]})::double AS {c}" if c in _CONSTANT else f"coalesce(m.{c}, d.{c})::double AS {c}"
    for c in FEATURE_LIST
) + " FROM mat m, medians d"


def clipped(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


STEPS["parts"] = f"""
    SELECT w.work_id, w.work_description, w.mp_name, w.recommended_amount, w.final_amount, w.recommendation_date, w.completed_date,
           w.recommendation_year, b.*  EXCLUDE (work_id), t.completion_delay_days, t.year_over_year_change AS yoy,
           f.is_impossible_date_sequence, f.is_covid_era, f.cost_deviation, f.constituency_max_vendor_share AS max_share,
           f.constituency_avg_vendor_transaction, f.constituency_pending_payment_ratio AS pending,
           x.nearest_similarity_score AS near, x.similar_project_count AS alike,
           s.allocated_amount, s.total_expenditure, s.utilization_pct, s.completed_works_count AS done,
           s.recommended_works_count AS every, s.completion_rate_pct AS rate,
           {r("coalesce(b.effective_amount, 0) / (coalesce(b.effective_amount, 0) + 100000)")} AS sev,
           {clipped(f"0.6::double * {clipped('percentile', 0, 100)} + 0.4::double * {clipped(clipped('z_score', 0, 10) + ' * 10', 0, 100)}", 0, 100)} AS financial_score,
           CASE WHEN f.is_impossible_date_sequence = 1 THEN 100.0
                ELSE {clipped(clipped("coalesce(t.year_over_year_change, 0)", 0, 1000) + " / 10", 0, 100)} END::double AS temporal_score,
           {clipped(f"0.5::double * ({clipped('f.constituency_max_vendor_share', 0, 1)} * 100) + 0.3::double * {clipped(clipped('f.constituency_pending_payment_ratio', 0, 1) + ' * 200', 0, 100)} + 0.2::double * ({clipped('f.constituency_avg_vendor_repeat_rate', 0, 1)} * 100)", 0, 100)} AS vendor_score,
           {clipped(clipped("x.nearest_similarity_score", 0, 1) + " * 100", 0, 100)} AS nlp_similarity_score,
           {clipped("100 - coalesce(s.completion_rate_pct, 50)", 0, 100)} AS mp_works_risk_score
    FROM works w JOIN base b USING (work_id) JOIN tmp t USING (work_id) JOIN filled f USING (work_id) JOIN wk_feats x USING (work_id)
         LEFT JOIN sponsors s ON w.mp_name = s.mp_name AND w.constituency = s.constituency"""

STEPS["model"] = f"""
    SELECT *, {r("0.2::double - 0.3::double * sev")} AS raw_anomaly_score,
           ({r("0.2::double - 0.3::double * sev")} < 0)::int AS is_anomaly,
           {clipped(clipped("sev", 0, 1) + " * 100", 0, 100)} AS isolation_forest_score FROM parts"""

STEPS["scores0"] = f"""
    SELECT *, {r("coalesce(0.30::double * financial_score + 0.20::double * temporal_score + 0.25::double * isolation_forest_score + 0.15::double * vendor_score + 0.10::double * mp_works_risk_score, 0)", 2)} AS final_risk_score FROM model"""

STEPS["scores1"] = """
    SELECT *, CASE WHEN final_risk_score <= 39.99 THEN 'LOW' WHEN final_risk_score <= 49.99 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_category,
           concat_ws(chr(10),
             CASE WHEN z_score > 2.5 OR percentile >= 95 OR financial_score >= 65 THEN
               '• Financial Benchmark Deviation: Expenditure of ₹' || format('{:,.2f}', effective_amount) || ' is unusually high compared with '
               || baseline_group || ' benchmark mean of ₹' || format('{:,.2f}', group_mean) || ' (Z-Score: +' || printf('%.2f', z_score)
               || ', Cohort Percentile: ' || printf('%.1f', percentile) || '%).'
             WHEN effective_amount > group_p99 THEN '• Upper-Tail Expenditure: Project cost ₹' || format('{:,.2f}', effective_amount)
               || ' exceeds the 99th percentile cohort ceiling of ₹' || format('{:,.2f}', group_p99) || '.' END,
             CASE WHEN is_impossible_date_sequence = 1 THEN
               '• Invalid Date Chronology: Completion date precedes recommendation date (impossible negative duration sequence).'
             WHEN temporal_score >= 60 OR yoy >= 200 THEN '• Constituency Project Volume Spike: Annual recommendation volume grew by +'
               || printf('%.1f', yoy) || '% YoY, indicating an unusual concentration of project approvals.' END,
             CASE WHEN max_share >= 0.40 OR vendor_score >= 60 THEN '• Vendor Expenditure Concentration: Single vendor commands '
               || printf('%.1f', max_share * 100) || '% of total constituency expenditure, exceeding normal competitive distribution thresholds.'
             WHEN pending >= 0.15 THEN '• Pending Payment Ratio: Constituency exhibits ' || printf('%.1f', pending * 100)
               || '% pending transaction ratio across active vendors.' END,
             CASE WHEN rate < 50 THEN '• Low Constituency Works Completion Rate: MP exhibits a low completion rate of ' || printf('%.1f', rate)
               || '% (' || done::bigint || ' completed out of ' || every::bigint
               || ' recommended works), signaling elevated execution backlog risk.' END,
             CASE WHEN is_anomaly = 1 OR isolation_forest_score >= 55 THEN '• Isolation Forest Machine Learning Pattern: Multi-dimensional feature isolation detected across combined financial, temporal, and vendor space (Model Severity: '
               || printf('%.1f', isolation_forest_score) || '/100).' END,
             CASE WHEN near >= 0.85 THEN '• Text Similarity Candidate: Work description matches ' || alike
               || ' other project(s) in constituency with high text similarity (' || printf('%.1f', near * 100) || '% cosine match score).' END
           ) AS bullets FROM scores0"""

STEPS["scores"] = """
    SELECT *, CASE WHEN bullets = '' THEN 'Standard baseline record (Final Risk Score: ' || printf('%.2f', final_risk_score)
                        || '/100): Project execution within expected cohort parameters.'
              ELSE CASE risk_category WHEN 'HIGH' THEN 'High priority for verification' WHEN 'MEDIUM' THEN 'Priority for verification'
                        ELSE 'Standard baseline record' END
                   || ' (Final Risk Score: ' || printf('%.2f', final_risk_score) || '/100):' || chr(10) || bullets END AS explanation
    FROM scores1"""

STEPS["master"] = f"""
    SELECT work_id, coalesce(mp_name, 'Unspecified MP') AS mp_name, project_status, state, constituency,
           coalesce(category, 'Normal/Others') AS category, coalesce(work_description, 'No description provided') AS work_description,
           coalesce(recommended_amount, 0) AS recommended_amount, coalesce(final_amount, 0) AS sanctioned_amount,
           coalesce(effective_amount, 0) AS effective_amount, coalesce(allocated_amount, 0) AS mp_allocated_amount,
           coalesce(total_expenditure, 0) AS mp_total_expenditure, coalesce(utilization_pct, 0) AS mp_utilization_pct,
           coalesce(done, 0)::bigint AS mp_completed_works, coalesce(every, 0)::bigint AS mp_recommended_works,
           coalesce(rate, 0) AS mp_completion_rate_pct, coalesce(recommendation_date, 'N/A') AS recommendation_date,
           'N/A' AS sanction_date, coalesce(completed_date, 'N/A') AS completion_date,
           coalesce(completion_delay_days, 0)::int AS duration_days, coalesce(recommendation_year, 2022)::int AS recommendation_year,
           is_impossible_date_sequence::int AS is_impossible_date_sequence, max_share AS constituency_max_vendor_share,
           pending AS constituency_pending_payment_ratio, {r("isolation_forest_score", 2)} AS isolation_forest_score, baseline_group,
           {r("group_mean", 2)} AS group_mean, {r("group_median", 2)} AS group_median, {r("group_p99", 2)} AS group_p99,
           {r("z_score", 2)} AS cost_z_score, {r("percentile", 1)} AS percentile, statistical_flag AS statistical_flags,
           {r("near", 4)} AS nearest_similarity_score, alike AS similar_project_count, {r("financial_score", 2)} AS financial_score,
           {r("temporal_score", 2)} AS temporal_score, {r("vendor_score", 2)} AS vendor_score, final_risk_score, risk_category,
           explanation, 'Not Reviewed' AS verification_status
    FROM scores"""
