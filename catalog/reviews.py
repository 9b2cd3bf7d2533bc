"""Registered queries: review log, screening of proposals, streams, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.inputs import P, analysed_works, master, raw, settled_works, sponsors, tidy
from catalog.oracles import STEPS, money_avg, oracle, quantile, r
from catalog.registry import query
from catalog.views import table, view
from worklens.operators import iforest
from worklens.plans import audit, clean, matrix, screening, text
from worklens.sources import io
from worklens.sources.staging import stage_root
from worklens.streaming import jobs


def _folder(spark, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def _reviews(spark, sf):
    return view(spark, sf, "reviews")


# Every second status is broken on purpose by the value, so that validation has something to reject.
STEPS["entries"] = "SELECT * REPLACE (CASE WHEN ai_risk_score_at_review < 2 THEN 'Maybe' ELSE review_status END AS review_status) FROM reviews"
STEPS["log"] = f"""
    SELECT * REPLACE (trim(reviewer_notes) AS reviewer_notes, CASE WHEN trim(coalesce(reviewer_id, '')) = '' THEN 'Auditor Officer' ELSE trim(reviewer_id) END AS reviewer_id,
                      {r("ai_risk_score_at_review", 2)} AS ai_risk_score_at_review) FROM entries WHERE review_status <> 'Maybe'"""
STEPS["latest"] = """
    SELECT work_id, max(review_timestamp) AS review_timestamp, """ + ", ".join(
    f"arg_max({c}, review_timestamp) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in
    ("log_id", "review_status", "reviewer_notes", "reviewer_id", "ai_risk_score_at_review", "ai_risk_category_at_review")) + " FROM log GROUP BY work_id"


def _entries(spark, sf):
    bad = F.when(F.col("ai_risk_score_at_review") < 2, "Maybe").otherwise(F.col("review_status"))
    return _reviews(spark, sf).withColumn("review_status", bad)


@query(oracle("SELECT * FROM log"))
def review_append(spark, sf):
    """Validated entries as they are found in the log after an append."""
    path = _folder(spark, "log")
    good, _ = audit.split_valid(_entries(spark, sf))
    io.append_parquet(good.where(F.col("review_status") == "Verified Normal"), path)
    io.append_parquet(good.where(F.col("review_status") != "Verified Normal"), path)
    return spark.read.parquet(path)


@query(oracle("SELECT log_id, review_status FROM entries WHERE review_status = 'Maybe'"))
def review_rejected(spark, sf):
    return audit.split_valid(_entries(spark, sf))[1].select("log_id", "review_status")


@query(oracle("SELECT * FROM latest"))
def latest_review(spark, sf):
    return audit.latest_reviews(audit.split_valid(_entries(spark, sf))[0])


@query(oracle("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY review_timestamp DESC, log_id DESC) AS k FROM log) WHERE k = 1"))
def latest_review_strict(spark, sf):
    return audit.latest_reviews(audit.split_valid(_entries(spark, sf))[0], strict=True)


@query(oracle("SELECT m.work_id, coalesce(l.review_status, 'Not Reviewed') AS verification_status FROM master m LEFT JOIN latest l USING (work_id)"))
def verification_status(spark, sf):
    log = audit.split_valid(_entries(spark, sf))[0]
    return audit.with_verification_status(master(spark, sf), log).select("work_id", "verification_status")


@query(oracle("SELECT 'AUDIT_' || lpad((500 + row_number() OVER (ORDER BY review_timestamp, work_id))::varchar, 6, '0') AS log_id, work_id, review_timestamp FROM reviews"))
def sequential_log_ids(spark, sf):
    out = audit.with_log_ids(_reviews(spark, sf).drop("log_id"), 500, ["review_timestamp", "work_id"])
    return out.select("log_id", "work_id", "review_timestamp")


@query(oracle("SELECT * FROM log WHERE work_id = 17 ORDER BY review_timestamp DESC"))
def review_history(spark, sf):
    return audit.history(audit.split_valid(_entries(spark, sf))[0], 17)


@query(oracle("SELECT * FROM log ORDER BY review_timestamp DESC"))
def ordered_log_table(spark, sf):
    """Log kept as a table, created empty, appended to, and read back newest first."""
    name = f"review_log_{uuid.uuid4().hex[:8]}"
    audit.create_log(spark, name)
    audit.append_reviews(_entries(spark, sf), name, f"{name}_rejected")
    return io.ordered_table(spark, name, "review_timestamp")


# Screening.

_PREPARED: dict[tuple, screening.History] = {}


def _history(spark, sf) -> screening.History:
    """Past works with their settled corpus; no model, so that SQL can follow the whole formula."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PREPARED:
        works = settled_works(spark, sf)
        _PREPARED[key] = screening.prepare_history(master(spark, sf), text.build_corpus(works, P))
    return _PREPARED[key]


def _proposals(spark, sf):
    return view(spark, sf, "proposals")


STEPS["cat_bench"] = f"""
    SELECT category, count(*) AS comparable, {money_avg("effective_amount")} AS hist_mean, stddev_samp(effective_amount) AS hist_std,
           {quantile("effective_amount", 0.5)} AS hist_median FROM master GROUP BY category
    UNION ALL SELECT '*', count(*), {money_avg("effective_amount")}, stddev_samp(effective_amount), {quantile("effective_amount", 0.5)} FROM master"""
STEPS["prop_clean"] = "SELECT DISTINCT trim(regexp_replace(lower(work_description), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS cleaned FROM proposals"
STEPS["prop_kept"] = "SELECT cleaned, list_filter(string_split(cleaned, ' '), lambda x: length(x) >= 2) AS ws FROM prop_clean"
STEPS["prop_tf"] = """
    SELECT cleaned, term, count(*) AS tf FROM (
        SELECT cleaned, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM prop_kept) GROUP BY ALL"""
STEPS["prop_w"] = """
    SELECT cleaned, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY cleaned)) AS w FROM prop_tf JOIN wk_vocab USING (term)"""
STEPS["prop_sim"] = """
    SELECT p.cleaned AS asked, w.cleaned AS past, sum(p.w * w.w) AS score FROM prop_w p JOIN wk_w w USING (term) GROUP BY ALL"""
STEPS["prop_best"] = """
    SELECT asked, max(score) AS best, coalesce(sum(c.copies) FILTER (WHERE score >= 0.85), 0)::bigint AS near
    FROM prop_sim JOIN wk_copies c ON past = c.cleaned GROUP BY asked"""
STEPS["prop"] = """
    SELECT p.*, coalesce(sanctioned_amount, recommended_amount) AS sanctioned,
           coalesce(sanctioned_amount, recommended_amount) / recommended_amount AS ratio,
           recommendation_date::date AS rec, coalesce(sanction_date::date, recommendation_date::date) AS san,
           coalesce(completion_date::date, coalesce(sanction_date::date, recommendation_date::date) + 180) AS com,
           b.comparable, b.hist_mean, b.hist_std, b.hist_median, coalesce(best, 0) AS best, coalesce(near, 0) AS near
    FROM proposals p JOIN cat_bench b ON b.category = CASE WHEN p.category IN (SELECT category FROM master) THEN p.category ELSE '*' END
         LEFT JOIN prop_best ON asked = trim(regexp_replace(lower(p.work_description), '[^\\p{L}\\p{N}]+', ' ', 'g'))"""
_IMPOSSIBLE = "(san < rec OR com < san)::int"
_DIFF = "CASE WHEN hist_median > 0 THEN (recommended_amount - hist_median) / hist_median * 100 ELSE 0 END"
STEPS["by_median"] = f"""
    SELECT *, {r("best * 100", 1)} AS sim, (recommended_amount - hist_median) / hist_std AS z FROM prop"""
STEPS["by_median_score"] = f"""
    SELECT *, least(100, greatest(0, 0.45::double * (least(z, 4.0::double) / 4.0::double * 100.0::double) + 0.30::double * sim + 0.25::double * 30.0::double)) AS score FROM by_median"""


@query(oracle(f"""
    SELECT proposal_id, recommended_amount AS proposed_amount, sanctioned AS sanctioned_amount, {r("ratio", 2)} AS recommendation_sanction_ratio,
           {r("hist_median", 2)} AS historical_median, {r(_DIFF, 1)} AS cost_difference_pct, comparable AS comparable_projects_count,
           {r("z", 2)} AS cost_z_score, sim AS nearest_similarity_pct, 30.0::double AS isolation_forest_score,
           'NORMAL (1)' AS isolation_forest_label, {_IMPOSSIBLE} AS is_impossible_date_sequence, {r("score", 1)} AS final_risk_score,
           CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM by_median_score"""))
def screening_by_median(spark, sf):
    return screening.score_by_median(_proposals(spark, sf), _history(spark, sf), P)


STEPS["const_med"] = f"""
    SELECT constituency, {quantile("constituency_max_vendor_share", 0.5)} AS share_med FROM master GROUP BY constituency"""
STEPS["by_mean0"] = f"""
    SELECT *, {_DIFF} AS diff, (recommended_amount - hist_mean) / hist_std AS dev,
           coalesce((SELECT 100.0::double * (count(*) FILTER (WHERE m.effective_amount < p.recommended_amount)::double / nullif(count(*), 0)) FROM master m WHERE m.state = p.state),
                    (SELECT 100.0::double * (count(*) FILTER (WHERE m.effective_amount < p.recommended_amount)::double / nullif(count(*), 0)) FROM master m)) AS sp,
           (SELECT 100.0::double * (count(*) FILTER (WHERE m.effective_amount < p.recommended_amount)::double / nullif(count(*), 0)) FROM master m WHERE m.constituency = p.constituency) AS cp
    FROM prop p"""
STEPS["by_mean1"] = f"""
    SELECT *, least(100, greatest(0, {r("0.40::double * least(100, greatest(0, sp * 0.6::double + least(abs(dev * 20.0::double), 100.0::double) * 0.4::double)) + 0.35::double * 50.0::double + 0.25::double * (best * 100.0::double)", 1)})) AS score FROM by_mean0"""
STEPS["by_mean"] = "SELECT *, CASE WHEN score < 40 THEN 'LOW' WHEN score <= 69.99 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM by_mean1"


@query(oracle(f"""
    SELECT proposal_id, {r("hist_median", 2)} AS historical_median, {r("diff", 1)} AS cost_difference_pct, {r("dev", 4)} AS cost_deviation,
           {r("sp", 4)} AS state_percentile, {r("coalesce(cp, sp)", 4)} AS const_percentile, {r("best", 6)} AS max_similarity, near AS similar_works,
           {r("coalesce(share_med, 0.35)")} AS constituency_max_vendor_share, {_IMPOSSIBLE} AS is_impossible_date_sequence,
           (com < san)::int AS is_negative_duration, (rec BETWEEN DATE '2020-03-01' AND DATE '2021-12-31')::int AS is_covid_era,
           50.0::double AS isolation_forest_score, 'NORMAL (1)' AS isolation_forest_label, score AS final_risk_score, level AS risk_level,
           concat_ws(chr(10),
             CASE WHEN san < rec OR com < san THEN '⚠️ **CRITICAL TEMPORAL ANOMALY**: Impossible date sequence detected! Sanction date precedes recommendation date or target completion date precedes sanction date.' END,
             CASE WHEN abs(ratio - 1) > 0.25 THEN '• Significant variance between Sanctioned Amount (₹' || format('{{:,.2f}}', sanctioned) || ') and Recommended Amount (₹'
               || format('{{:,.2f}}', recommended_amount) || ') (Ratio: ' || printf('%.2f', ratio) || ').' END,
             '• Proposed amount (₹' || format('{{:,.2f}}', recommended_amount) || ') is ' ||
               CASE WHEN diff > 25 THEN 'significantly higher (' || printf('%+.1f', diff) || '%) than' WHEN diff < -25 THEN 'lower (' || printf('%.1f', diff) || '%) than'
                    ELSE 'aligned with' END || ' the historical median (₹' || format('{{:,.2f}}', hist_median) || ') for ''' || p.category || ''' works.',
             CASE WHEN best >= 0.85 THEN '• Work description is highly similar (' || printf('%.1f', best * 100) || '% cosine match) to ' || near || ' existing historical project(s).'
                  WHEN best >= 0.6 THEN '• Work description exhibits moderate text similarity (' || printf('%.1f', best * 100) || '% match) with existing historical projects.'
                  ELSE '• Work description exhibits a standard unique text pattern with low description overlap.' END,
             '• **Isolation Forest ML Model**: Feature pattern is consistent with normal historical project clusters (Isolation Score: 50.0/100 | Label: NORMAL (1)).',
             CASE WHEN level <> 'LOW' THEN '• Overall risk evaluation flagged this proposed work — human verification recommended.' END) AS reasons
    FROM by_mean p LEFT JOIN const_med c ON p.constituency = c.constituency"""))
def screening_by_mean(spark, sf):
    return screening.score_by_mean(_proposals(spark, sf), _history(spark, sf), P)


STEPS["prop_found"] = """
    SELECT p.proposal_id, c.work_id, score FROM proposals p
    JOIN prop_sim s ON s.asked = trim(regexp_replace(lower(p.work_description), '[^\\p{L}\\p{N}]+', ' ', 'g')) JOIN wk_clean c ON c.cleaned = s.past"""
STEPS["prop_any"] = """
    SELECT * FROM prop_found UNION ALL
    SELECT proposal_id, work_id, 0.0::double FROM proposals, (SELECT work_id FROM master ORDER BY work_id LIMIT 10)
    WHERE (proposal_id, work_id) NOT IN (SELECT (proposal_id, work_id) FROM prop_found)"""


@query(oracle(f"""
    SELECT proposal_id, rank, work_id, match_description, category, effective_amount, state, similarity_pct FROM (
        SELECT f.proposal_id, m.work_id, m.work_description AS match_description, m.category, m.effective_amount, m.state,
               {r("score * 100", 1)} AS similarity_pct,
               row_number() OVER (PARTITION BY f.proposal_id ORDER BY {r("score", 9)} DESC, m.work_id) AS rank
        FROM prop_any f JOIN master m USING (work_id)) WHERE rank <= 5"""))
def similar_matches_of_proposals(spark, sf):
    history = _history(spark, sf)
    works = settled_works(spark, sf).select("work_id", "state", "constituency", "work_description")
    shown = works.join(master(spark, sf).select("work_id", "category", "effective_amount"), "work_id")
    return screening.similar_matches(_proposals(spark, sf), history.corpus, shown, 5, P)


@query(oracle(f"SELECT proposal_id, {r('hist_median', 2)} AS hist_median, {r('hist_mean', 2)} AS hist_mean, {r('hist_std', 2)} AS hist_std, comparable FROM prop"))
def proposal_benchmarks(spark, sf):
    df = screening.with_benchmark(_proposals(spark, sf), screening.category_benchmarks(master(spark, sf)))
    return tidy(df.select("proposal_id", "hist_median", "hist_mean", "hist_std", "comparable"), "hist_median hist_mean hist_std", 2)


@query(oracle(f"SELECT proposal_id, {_IMPOSSIBLE} AS is_impossible_date_sequence, (com < san)::int AS is_negative_duration, (rec BETWEEN DATE '2020-03-01' AND DATE '2021-12-31')::int AS is_covid_era FROM prop"))
def proposal_date_rules(spark, sf):
    return screening.with_dates(_proposals(spark, sf), P).select("proposal_id", "is_impossible_date_sequence", "is_negative_duration", "is_covid_era")


@query(oracle(f"SELECT proposal_id, {r('sp', 4)} AS state_percentile, {r('coalesce(cp, sp)', 4)} AS const_percentile FROM by_mean0"))
def proposal_percentiles(spark, sf):
    df = screening.with_percentiles(_proposals(spark, sf), master(spark, sf))
    return tidy(df.select("proposal_id", "state_percentile", "const_percentile"), "state_percentile const_percentile", 4)


_MEDIANS = {"constituency_max_vendor_share": "0.35", "constituency_avg_vendor_transaction": "500000", "constituency_pending_payment_ratio": "0.1"}
STEPS["const_medians"] = "SELECT constituency, " + ", ".join(f"{quantile(c, 0.5)} AS {c}" for c in _MEDIANS) + " FROM filled WHERE constituency IS NOT NULL GROUP BY constituency"


@query(oracle("SELECT proposal_id, " + ", ".join(f"{r(f'coalesce(c.{c}, {other}::double)', 4)} AS {c}" for c, other in _MEDIANS.items()) + " FROM proposals p LEFT JOIN const_medians c ON p.constituency = c.constituency"))
def proposal_vendor_medians(spark, sf):
    df = screening.with_vendor_medians(_proposals(spark, sf), analysed_works(spark, sf))
    return tidy(df.select("proposal_id", *_MEDIANS), " ".join(_MEDIANS), 4)


@query(oracle(f"SELECT work_id, {r('least(100, greatest(0, (-raw_anomaly_score + 0.20::double) / 0.50::double * 100.0::double))')} AS score_100, CASE WHEN raw_anomaly_score < 0 OR least(100, greatest(0, (-raw_anomaly_score + 0.20::double) / 0.50::double * 100.0::double)) >= 55 THEN -1 ELSE 1 END AS label FROM model"))
def rescaled_decision(spark, sf):
    score = screening.rescaled(F.col("raw_anomaly_score"))
    label = F.when((F.col("raw_anomaly_score") < 0) | (score >= 55.0), -1).otherwise(1)
    return tidy(analysed_works(spark, sf).select("work_id", score.alias("score_100"), label.alias("label")), "score_100")


@query()
def screening_with_model(spark, sf):
    """Both formulas with a fitted forest."""
    df = analysed_works(spark, sf).select(*matrix.active_features())
    history = _history(spark, sf)
    forest = iforest.fit(df, matrix.active_features(), P)
    past = screening.History(history.master, history.corpus, history.benchmarks, history.benchmarks_any_case, forest)
    a = screening.score_by_median(_proposals(spark, sf), past, P).select("proposal_id", F.col("final_risk_score").alias("score_by_median"))
    b = screening.score_by_mean(_proposals(spark, sf), past, P).select("proposal_id", F.col("final_risk_score").alias("score_by_mean"))
    return a.join(b, "proposal_id")


# Streams, run to the end of what has arrived.

PROPOSAL_SCHEMA = (
    "proposal_id bigint, work_description string, category string, recommended_amount double, sanctioned_amount double, "
    "state string, constituency string, recommendation_date string, sanction_date string, completion_date string"
)


@query(oracle(f"SELECT proposal_id, {r('score', 1)} AS final_risk_score FROM by_median_score"))
def screening_stream(spark, sf):
    arrived, out = _folder(spark, "arrived"), _folder(spark, "screened")
    _proposals(spark, sf).repartition(4).write.parquet(arrived)
    stream = jobs.file_stream(spark, arrived, PROPOSAL_SCHEMA, files_per_batch=2)
    jobs.screen_stream(stream, _history(spark, sf), out, _folder(spark, "cp"), p=P).awaitTermination()
    return spark.read.parquet(out).select("proposal_id", "final_risk_score")


@query(oracle("SELECT * FROM log"))
def review_stream(spark, sf):
    """Every entry is delivered twice, in several batches, the oldest ones last; each is logged once."""
    arrived, log = _folder(spark, "arrived"), _folder(spark, "log")
    entries = _entries(spark, sf)
    middle = entries.agg(F.percentile_approx(F.unix_micros(F.col("review_timestamp").cast("timestamp")), 0.5)).first()[0]
    newer = F.unix_micros(F.col("review_timestamp").cast("timestamp")) >= middle
    for part in (entries.where(newer), entries, entries.where(~newer)):
        part.repartition(8).write.mode("append").parquet(arrived)
    stream = jobs.file_stream(spark, arrived, audit.LOG_SCHEMA, files_per_batch=8)
    jobs.review_stream(stream, log, _folder(spark, "rejected"), _folder(spark, "cp")).awaitTermination()
    return spark.read.parquet(log).drop("batch")


@query(oracle("SELECT work_id, review_timestamp, review_status FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY review_timestamp DESC, log_id DESC) AS k FROM entries WHERE review_status <> 'Maybe') WHERE k = 1"))
def review_status_stream(spark, sf):
    arrived, out = _folder(spark, "arrived"), _folder(spark, "status")
    _entries(spark, sf).repartition(4).write.parquet(arrived)
    stream = jobs.file_stream(spark, arrived, audit.LOG_SCHEMA, files_per_batch=1)
    jobs.status_stream(stream, out, _folder(spark, "cp")).awaitTermination()
    return jobs.current_status(spark, out)


# Sources and sinks: what was written is what is read back.

_PAY_SCHEMA = "mp_name string, constituency string, state string, work_description string, vendor string, ida string, expenditure_amount string, expenditure_date string, payment_status string"


def _round_trip(spark, sf, compressed: bool):
    path = _folder(spark, "csv")
    io.write_csv(clean.canonical(raw(spark, sf, "payments_raw"), clean.PAYMENT_TITLES), path, compressed)
    return io.read_csv(spark, path, _PAY_SCHEMA, spread=8 if compressed else None)


_BROKEN = "concat(work_description, '\\n\"second\", line of ', vendor)"


@query(oracle("""
    SELECT * REPLACE (trim(expenditure_amount) AS expenditure_amount, work_description || chr(10) || '"second", line of ' || vendor AS work_description),
           NULL::VARCHAR AS malformed FROM (SELECT mp_name, constituency, state, work_description, vendor, ida, expenditure_amount, expenditure_date, payment_status FROM payments_raw)"""))
def csv_round_trip(spark, sf):
    """All columns, with descriptions that hold line breaks, quotes and commas."""
    path = _folder(spark, "csv")
    rows = clean.canonical(raw(spark, sf, "payments_raw"), clean.PAYMENT_TITLES).withColumn("work_description", F.expr(_BROKEN))
    io.write_csv(rows, path)
    read = io.read_csv(spark, path, _PAY_SCHEMA, keep_malformed=True)
    return read.withColumn("expenditure_amount", F.trim("expenditure_amount")).withColumnRenamed(io.MALFORMED, "malformed")


@query(oracle("SELECT vendor, count(*) AS rows FROM payments_raw GROUP BY vendor"))
def gzip_csv_round_trip(spark, sf):
    return _round_trip(spark, sf, True).groupBy("vendor").agg(F.count(F.lit(1)).alias("rows"))


@query(oracle("SELECT * FROM sponsors".replace("*", "mp_name, allocated_amount, recommended_works_count")))
def table_round_trip(spark, sf):
    name = f"sponsors_{uuid.uuid4().hex[:8]}"
    rows = sponsors(spark, sf).select("mp_name", "allocated_amount", "recommended_works_count")
    io.replace_table(rows.limit(0), name)
    io.replace_table(rows, name)
    return io.read_table(spark, name)


@query(oracle("SELECT risk_category, work_id, state, final_risk_score FROM master WHERE risk_category = 'HIGH'"))
def lookup_layout(spark, sf):
    name = f"master_{uuid.uuid4().hex[:8]}"
    io.write_lookup_layout(master(spark, sf), name, buckets=8)
    return spark.table(name).where("risk_category = 'HIGH'").select("risk_category", "work_id", "state", "final_risk_score")


STEPS["offered"] = "SELECT source || '-' || doc_id AS file_name, sha256(text) AS sha256 FROM documents"
STEPS["landed"] = "SELECT lang || '-' || doc_id AS other, source || '-' || doc_id AS file_name, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS landed_sha256 FROM documents WHERE lang <> 'fr'"


@query(oracle("""
    SELECT o.file_name, o.sha256, CASE WHEN landed_sha256 IS NULL THEN 'copy' WHEN landed_sha256 = o.sha256 THEN 'keep (checksum match)'
           ELSE 'keep first (checksum differs)' END AS action FROM offered o LEFT JOIN landed l USING (file_name)"""))
def immutable_landing_plan(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat_ws("-", "source", "doc_id").alias("file_name")
    offered = docs.select(name, F.sha2("text", 256).alias("sha256"))
    kept = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    landed = docs.where(F.col("lang") != "fr").select(name, F.sha2(kept, 256).alias("sha256"))
    return io.landing_plan(offered, landed).select("file_name", "sha256", "action")


_DATASETS = {
    "payments": ("payments_raw", clean.PAYMENT_TITLES),
    "recommended": ("recommended_raw", clean.RECOMMENDED_TITLES),
    "completed": ("completed_raw", clean.COMPLETED_TITLES),
    "sponsors": ("sponsor_raw", clean.SPONSOR_TITLES),
}


@query(oracle(" UNION ALL ".join(
    f"SELECT '{name}' AS dataset, count(*) AS row_count, {len(titles)}::bigint AS column_count, '{c}' AS column_name, count(*) - count({c}) AS null_count, "
    f"{r(f'100.0::double * (count(*) - count({c})) / count(*)', 2)} AS null_percentage FROM {source}"
    for name, (source, titles) in _DATASETS.items() for c in titles.values())))
def dataset_manifest(spark, sf):
    """Every column of all four datasets, as the manifest file holds them."""
    path = _folder(spark, "manifest")
    io.write_manifest({name: clean.canonical(raw(spark, sf, source), titles) for name, (source, titles) in _DATASETS.items()}, path)
    rows = spark.read.json(path).select("dataset", "row_count", "column_count", F.inline("columns"))
    return tidy(rows.select("dataset", "row_count", "column_count", "column_name", "null_count", "null_percentage"), "null_percentage", 2)
