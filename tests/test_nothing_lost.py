"""Inputs and streams that must not lose rows: late decisions, quoted line breaks, nulls, orders of every status."""

import os

import pytest
from pyspark.sql import functions as F

from worklens.operators import quality
from worklens.plans import audit
from worklens.sources import io, staging
from worklens.streaming import jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def entry(log_id, day, status="Verified Normal"):
    return (log_id, 7, status, "note", "me", day, 1.0, "LOW")


def test_late_and_repeated_decisions_over_several_batches(spark, tmp_path):
    arrived, log, rejected = (str(tmp_path / x) for x in ("arrived", "log", "rejected"))
    schema = audit.LOG_SCHEMA.replace("timestamp_ntz", "string")
    batches = [
        [entry("A", "2024-06-01"), entry("A", "2024-06-01"), entry("B", "2024-06-02", "Maybe")],
        [entry("A", "2024-06-01"), entry("C", "2024-01-01"), entry("B", "2024-06-02", "Maybe"), entry(None, "2020-01-01"), entry(None, "2020-01-01")],
        [entry("D", "1999-01-01"), entry("E", None), entry("C", "2024-01-01")],
    ]
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("review_timestamp", F.col("review_timestamp").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(arrived)
        for _ in range(2):  # a run with nothing new changes nothing
            stream = jobs.file_stream(spark, arrived, audit.LOG_SCHEMA, files_per_batch=1)
            jobs.review_stream(stream, log, rejected, str(tmp_path / "checkpoint")).awaitTermination()
    logged = [r.log_id for r in spark.read.parquet(log).select("log_id").collect()]
    assert sorted(logged, key=str) == ["A", "C", "D", "E", None, None]
    assert [r.log_id for r in spark.read.parquet(rejected).select("log_id").collect()] == ["B"]


def test_csv_with_quoted_line_breaks_and_malformed_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"line one\nline two, ""quoted"""\n2,plain\nx,bad\n3,\n')
    rows = io.read_csv(spark, str(path), "id int, text string", keep_malformed=True).cache()
    assert [(r.id, r.text) for r in rows.where("_malformed IS NULL").collect()] == [(1, 'line one\nline two, "quoted"'), (2, "plain"), (3, None)]
    assert tuple(io.malformed_count(rows).first()) == (4, 1)
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        io.read_csv(spark, str(path), "id int, text string").collect()


def test_correlation_uses_every_complete_pair(spark):
    rows = [(float(i), float(i * i % 17), None if i < 15 else float(-i)) for i in range(30)] + [(float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.feature_1, r.feature_2): r.r for r in quality.correlated_pairs(df, ["a", "b", "c"], 0.0).collect()}
    pairs = df.toPandas().corr()
    assert got == {(x, y): pytest.approx(pairs.loc[x, y]) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))}
    assert quality.correlated_pairs(df.limit(0), ["a", "b"], 0.0).count() == 0


def test_stage_folder_must_be_shared_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        staging.stage_root(Session())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_order_is_a_work(spark):
    from catalog.inputs import works

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    have = works(spark, SF)
    assert have.select("work_id").distinct().count() == orders.count()
    assert {r.project_status for r in have.select("project_status").distinct().collect()} == {"Recommended", "Completed", "Recommended & Completed"}


def test_run_table_tells_of_a_failed_stage(spark):
    from worklens.plans import batch

    run = batch.Run()
    run.stage("first", lambda: spark.range(3))

    def broken():
        raise RuntimeError("no input")

    with pytest.raises(RuntimeError):
        run.stage("second", broken)
    rows = [(r.stage, r.status, r.rows, r.error) for r in run.report(spark).orderBy("position").collect()]
    assert rows == [("first", "done", 3, None), ("second", "failed", None, "RuntimeError: no input")]


def test_a_corrected_review_is_logged(spark, tmp_path):
    """Bad status first, then a good one in the next batch; repeats are dropped and entries that contradict the log rejected."""
    import datetime

    from worklens.plans import audit
    from worklens.streaming import jobs

    def entry(log_id, status, minute, notes="n"):
        return (log_id, 5, status, notes, "r", datetime.datetime(2026, 1, 1, 0, minute), 1.0, "LOW")

    good, bad = "Verified Normal", "Maybe"
    batches = [
        [entry("A", bad, 1), entry("B", good, 1), entry("B", good, 2, "other"), entry(None, good, 3)],
        [entry("A", good, 2), entry("A", bad, 1), entry("B", good, 1), entry(None, good, 3)],
        [entry("A", good, 2), entry("A", good, 5, "later"), entry("C", bad, 1), entry(None, bad, 1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, audit.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.file_stream(spark, f"{tmp_path}/in", audit.LOG_SCHEMA)
        jobs.review_stream(stream, f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    key = lambda rows: sorted((str(r.log_id), r.review_status, r.reviewer_notes, r.review_timestamp.minute) for r in rows)
    assert key(spark.read.parquet(f"{tmp_path}/log").collect()) == sorted([("A", good, "n", 2), ("B", good, "n", 1), ("None", good, "n", 3), ("None", good, "n", 3)])
    assert key(spark.read.parquet(f"{tmp_path}/bad").collect()) == sorted([("A", bad, "n", 1), ("A", good, "later", 5), ("B", good, "other", 2), ("C", bad, "n", 1), ("None", bad, "n", 1)])


def test_a_flat_feature_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 0.1, 2.0, 5.0), (2.0, 0.1, 4.0, 7.0), (3.0, 0.1, 6.0, None)], "a double, flat double, b double, c double")
    assert [(r.feature_1, r.feature_2, round(r.r, 9)) for r in quality.correlated_pairs(df, ["a", "flat", "b", "c"]).orderBy("feature_1", "feature_2").collect()] == [
        ("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0)]


def test_review_state_is_native_and_the_earliest_valid_entry_is_logged(spark, tmp_path):
    """No Python function runs per id; a batch's earliest valid entry of an id is logged, one without a time last."""
    import datetime

    def row(log_id, status, day, notes):
        return (log_id, 5, status, notes, "r", day and datetime.datetime(2026, 1, day), 1.0, "LOW")

    good = "Verified Normal"
    for rows in ([row("A", good, None, "x"), row("A", good, 3, "y"), row("A", good, 2, "z"), row("A", "Maybe", 1, "w"), row("B", good, None, "x")], [row("A", good, 1, "late")]):
        spark.createDataFrame(rows, audit.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.file_stream(spark, f"{tmp_path}/in", audit.LOG_SCHEMA)
        query = jobs.review_stream(stream, f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/cp")
        query.awaitTermination()
        assert [o["operatorName"] for o in query.recentProgress[0]["stateOperators"]] == ["dedupe"]
    assert sorted((r.log_id, r.reviewer_notes) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [("A", "z"), ("B", "x")]
    assert sorted(r.reviewer_notes for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == ["late", "w", "x", "y"]


def test_scores_and_master_are_not_stored_again(spark, monkeypatch):
    """Both follow from a work's own columns, so wide rows are stored once, as analysed works."""
    from catalog import inputs

    stored, rows = [], spark.createDataFrame([(1,), (2,)], "work_id long")
    monkeypatch.setattr(inputs, "settle_once", lambda spark, key, make: stored.append(key[0]) or make())
    monkeypatch.setattr(inputs, "analysed_works", lambda *_: rows)
    monkeypatch.setattr(inputs.batch, "scored", lambda df, p: df)
    monkeypatch.setattr(inputs, "master_table", lambda df, p: df)
    assert inputs.master(spark, "anywhere").count() == inputs.scored_works(spark, "anywhere").count() == 2
    assert stored == []
