import datetime as dt

from pyspark.sql import functions as F

from worklens.operators import explorer
from worklens.params import Params
from worklens.plans import audit, clean, temporal

TS = dt.datetime


def test_unify_by_side_and_repeated_ids(spark):
    rec = [(1, "r1", "m", "c", "s", 10.0, "2020-01-01", 2020, True, "i"), (2, "r2", "m", "c", "s", 20.0, None, None, None, "i"),
           (2, "r2b", "m", "c", "s", 30.0, None, None, None, "i")]
    comp = [(2, None, "k", None, "c2", "s", 5.0, "2019-01-01", 2019, None, None, None), (3, "d3", None, "m", "c", "s", 7.0, None, None, None, None, "j")]
    r = spark.createDataFrame(rec, "work_id long, work_description string, mp_name string, constituency string, state string, recommended_amount double, recommendation_date string, recommendation_year int, has_images boolean, ida string")
    c = spark.createDataFrame(comp, "work_id long, work_description string, category string, mp_name string, constituency string, state string, final_amount double, completed_date string, completed_year int, has_images boolean, average_rating double, ida string")
    got = sorted((x["work_id"], x["project_status"], x["work_description"], x["constituency"], x["is_covid_era"]) for x in clean.unify_works(r, c).collect())
    assert got == [
        (1, "Recommended", "r1", "c", True),
        (2, "Recommended & Completed", "r2", "c2", False),
        (2, "Recommended & Completed", "r2b", "c2", False),
        (3, "Completed", "d3", "c", False),
    ]


def test_year_change_needs_both_years(spark):
    rows = [("a", 2000), ("a", 2000), ("a", 2001), ("b", 2001), ("c", None), ("d", 1990)]
    df = spark.createDataFrame(rows, "g string, y int")
    got = {r["g"]: r["x"] for r in temporal.year_change(df, ["g"], "y", (2000, 2001), "x").collect()}
    assert got == {"a": -50.0, "b": None, "d": None}
    gone = temporal.year_change(df, ["g"], "y", (2001, 2002), "x")
    assert {r["x"] for r in gone.collect()} == {None}


def test_year_change_reads_rows_from_ctes_once(spark):
    spark.createDataFrame([("a", 2000, 2.0), ("a", 2001, 3.0), ("b", 2001, 1.0)], "g string, y int, x double").createOrReplaceTempView("years_and_sums")
    rows = spark.sql("WITH r AS (SELECT * FROM years_and_sums), s AS (SELECT g, y, x FROM r UNION ALL SELECT g, y, x FROM r WHERE x = 2) SELECT * FROM s")
    change = temporal.year_change(rows, ["g"], "y", (2000, 2001), "c", F.col("x"))
    assert {r["g"]: r["c"] for r in change.collect()} == {"a": -25.0, "b": None}
    # With the rows' plan in the sums and in the subquery on them, vendor_year_change ended with an invalid plan as the first query of a session.
    assert "CTE" not in change._jdf.queryExecution().analyzed().toString()


LOG = [
    ("AUDIT_000001", 61773, "Needs Further Review", "check site", "O1", TS(2026, 9, 1, 17, 4), 80.18, "HIGH"),
    ("AUDIT_000002", 61773, "Needs Further Review", "check site", "O1", TS(2026, 9, 1, 17, 17), 80.18, "HIGH"),
    ("AUDIT_000003", 61773, "Verified Normal", None, "O1", TS(2026, 9, 8, 5, 15), 71.7, "HIGH"),
    ("AUDIT_000004", 837, "Manual Investigation Required", None, "O1", TS(2026, 9, 16, 10, 56), 51.77, "HIGH"),
]


def test_latest_review_carries_non_null_columns(spark):
    log = spark.createDataFrame(LOG, audit.LOG_SCHEMA)
    kept = {r["work_id"]: r for r in audit.latest_reviews(log).collect()}
    assert kept[61773]["review_status"] == "Verified Normal" and kept[61773]["ai_risk_score_at_review"] == 71.7
    assert kept[61773]["reviewer_notes"] == "check site" and kept[837]["reviewer_notes"] is None
    strict = {r["work_id"]: r for r in audit.latest_reviews(log, strict=True).collect()}
    assert strict[61773]["reviewer_notes"] is None and strict[61773]["log_id"] == "AUDIT_000003"


def test_review_validation_and_ids(spark):
    rows = [(None, 1, "Verified Normal", "  ok ", "  ", TS(2026, 1, 2), 1.255, "LOW"), (None, 2, "Guilty", "x", "y", TS(2026, 1, 1), 2.0, "LOW"),
            (None, 3, None, "x", "y", TS(2026, 1, 1), 2.0, "LOW")]
    good, bad = audit.split_valid(spark.createDataFrame(rows, audit.LOG_SCHEMA))
    row = audit.with_log_ids(good, 6, ["review_timestamp"]).first()
    assert (row["reviewer_notes"], row["reviewer_id"], row["log_id"]) == ("ok", "Auditor Officer", "AUDIT_000007")
    assert {r["work_id"] for r in bad.collect()} == {2, 3}


def test_search_is_literal_and_pages_do_not_overlap(spark):
    df = spark.createDataFrame([(i, f"road (no. {i})", 50.0) for i in range(10)], "work_id long, work_description string, final_risk_score double")
    assert explorer.search(df, "(NO. 3)", ["work_description"]).count() == 1
    assert explorer.search(df, "  ", ["work_description"]).count() == 10
    first = explorer.page(df, "final_risk_score", "work_id", 4, 0).collect()
    second = explorer.page(df, "final_risk_score", "work_id", 4, 4).collect()
    assert [r["work_id"] for r in first + second] == list(range(8))


def test_review_stream_logs_each_entry_once(spark, tmp_path):
    from worklens.streaming import jobs

    src = str(tmp_path / "in")
    entries = spark.createDataFrame(LOG, audit.LOG_SCHEMA)
    entries.unionByName(entries).write.parquet(src)
    for _ in range(2):  # a second run over the same folder finds nothing new
        stream = jobs.file_stream(spark, src, audit.LOG_SCHEMA, files_per_batch=1)
        jobs.review_stream(stream, str(tmp_path / "log"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "log")).select("log_id").collect()) == [x[0] for x in LOG]


def test_landing_keeps_the_first_copy(spark, tmp_path):
    from worklens.sources import io

    src, out = tmp_path / "src", str(tmp_path / "landed")
    src.mkdir()
    (src / "a.csv").write_text("x\n1\n")
    assert [r["action"] for r in io.land(spark, str(src), out).collect()] == ["copy"]
    (src / "a.csv").write_text("x\n2\n")
    (src / "b.csv").write_text("y\n")
    got = {r["file_name"]: r["action"] for r in io.land(spark, str(src), out).collect()}
    assert got == {"a.csv": "keep first (checksum differs)", "b.csv": "copy"}
    kept = {r["file_name"]: bytes(r["content"]) for r in spark.read.parquet(out).collect()}
    assert kept == {"a.csv": b"x\n1\n", "b.csv": b"y\n"}


def test_evidence_texts(spark):
    from worklens.plans.risk import evidence

    base = dict(z_score=0.0, percentile=50.0, financial_score=10.0, effective_amount=1.0, group_p99=5.0, group_mean=2.0,
                baseline_group="State: x", is_impossible_date_sequence=0, temporal_score=0.0, year_over_year_change=0.0,
                constituency_max_vendor_share=0.1, vendor_score=0.0, constituency_pending_payment_ratio=0.0,
                completion_rate_pct=80.0, completed_works_count=8, recommended_works_count=10, is_anomaly=0,
                isolation_forest_score=1.0, nearest_similarity_score=0.0, similar_project_count=0,
                final_risk_score=12.5, risk_category="LOW")
    loud = {**base, "z_score": 3.0, "is_impossible_date_sequence": 1, "constituency_pending_payment_ratio": 0.2,
            "completion_rate_pct": 40.0, "is_anomaly": 1, "nearest_similarity_score": 0.9, "similar_project_count": 2,
            "risk_category": "HIGH"}
    top = {**base, "effective_amount": 6.0}
    quiet, full, tail = [r[0] for r in spark.createDataFrame([base, loud, top]).select(evidence(Params())).collect()]
    assert quiet == "Standard baseline record (Final Risk Score: 12.50/100): Project execution within expected cohort parameters."
    assert full.startswith("High priority for verification (Final Risk Score: 12.50/100):\n• Financial Benchmark Deviation")
    assert full.count("\n•") == 6 and "Pending Payment Ratio" in full
    assert "Upper-Tail Expenditure" in tail
    for word in ("fraud", "corrupt", "guilty"):
        assert word not in full.lower()


def test_missing_value_does_not_hide_rows(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert explorer.where_equal(df, {"x": None}).count() == 2
    assert explorer.existing(df.withColumn("y", F.lit(1)), ["y", "z"]).columns == ["y"]
