"""Steps of the analysed works that were shuffled or stored more often than needed: same rows, fewer exchanges."""

from pyspark.sql import functions as F

from catalog import views
from worklens.functions import ranks
from worklens.params import Params
from worklens.plans import baselines, batch, financial, matrix, vendor

P = Params(min_group=2)
WORKS = (
    "work_id long, project_status string, work_description string, category string, mp_name string, constituency string, state string, ida string, "
    "recommended_amount double, final_amount double, recommendation_date string, completed_date string, recommendation_year int, "
    "completed_year int, has_images boolean, average_rating double, is_covid_era boolean"
)
PAYMENTS = (
    "mp_name string, constituency string, state string, work_description string, vendor string, ida string, expenditure_amount double, "
    "payment_status string, expenditure_date_iso string, expenditure_year int"
)
SPONSORS = "mp_name string, constituency string, " + ", ".join(
    f"{c} double" for c in ("allocated_amount", "total_expenditure", "utilization_pct", "completed_works_count", "recommended_works_count", "completion_rate_pct")
)


def works(spark):
    rows = []
    for i in range(40):
        place = None if i % 13 == 0 else f"C{i % 3}"
        amount = None if i % 11 == 0 else float(100 * (i % 7))
        rows.append((
            None if i == 5 else i % 35, "Recommended", f"repair of road {i % 4}", None if i % 5 == 0 else f"K{i % 4}", f"M{i % 3}", place, f"S{i % 2}", "x",
            amount, None if i % 2 else 50.0 * i, "2024-01-01" if i % 2 else "2025-02-01", None, 2024 + i % 2, None, None, None, False,
        ))
    return spark.createDataFrame(rows + rows[3:6], WORKS)


def payments(spark):
    rows = []
    for i in range(60):
        seller = None if i % 17 == 0 else f"V{i % 5}"
        rows.append((
            f"M{i % 3}", None if i % 9 == 0 else f"C{i % 3}", f"S{i % 2}", "road", seller, "x", None if i % 8 == 0 else 10.25 * i,
            vendor.SUCCESS if i % 3 else None, None if i % 10 == 0 else f"2025-0{1 + i % 3}-1{i % 7}", 2025 + i % 2,
        ))
    return spark.createDataFrame(rows + rows[:4], PAYMENTS)


def sponsors(spark):
    return spark.createDataFrame([(f"M{i % 3}", f"C{i % 3}", 10.0 + i, 5.0, 1.0, 2.0, 3.0, 40.0 + i) for i in range(4)], SPONSORS)


def plain(df, columns=None):
    columns = sorted(columns or df.columns)
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


def test_rank_of_counted_rows_is_that_of_the_rows(spark):
    rows = [(g, v, n) for g, v, n in [("a", 1.0, 3), ("a", 2.0, 1), ("a", 2.004, 2), ("a", -5.0, 1), ("b", 7.0, 4), (None, 1.0, 2), ("a", None, 2), ("c", 1.0, 1)]]
    counted = spark.createDataFrame(rows, "g string, v double, n long")
    single = counted.select("g", "v", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    want = {(r.g, r.v): r.p for r in ranks.percentile_ranks(single, ["g"], "v", "p", 2).collect()}
    got = {(r.g, r.v): r.p for r in ranks.with_percentile_rank(counted, "g", "v", "n", "p", 2).collect()}
    assert set(got) == {(g, v) for g, v, _ in rows}
    assert {k: p for k, p in got.items() if p is not None} == want


def test_cohort_inputs_are_those_of_vendor_features(spark):
    every, lean = vendor.vendor_features(payments(spark), P), vendor.cohort_inputs(payments(spark))
    columns = ["vendor", "state", "constituency", "vendor_share_of_constituency_expenditure", "average_vendor_transaction", "vendor_repeat_rate", "pending_payment_ratio"]
    assert plain(lean, columns) == plain(every, columns)
    assert plain(vendor.vendor_cohorts(lean)) == plain(vendor.vendor_cohorts(every))


def test_analysed_works_are_those_of_separate_steps(spark):
    inputs = works(spark), payments(spark), sponsors(spark)
    whole, fill = batch.analysed(*inputs, P)
    steps, again = batch.analysed(*inputs, P, matrix.with_all_features(*inputs, P))
    assert fill == again and whole.columns == steps.columns
    assert plain(whole) == plain(steps) and whole.count() == 43


def test_wide_works_go_to_their_ranks_once(spark):
    """Cost ranks and the rank in the cohort come by one join on the amount; they were two, of wide rows each."""
    source = financial.with_effective_amount(works(spark))
    sizes = baselines.cohort_sizes(source)
    df = financial.with_financial(works(spark), sponsors(spark), P, sizes=sizes)
    plan = baselines.with_baseline(df, P, source, sizes)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join LeftOuter" in line and "effective_amount" in line for line in plan.splitlines()) == 1


def test_payment_lines_are_read_as_the_view_says(spark, tmp_path):
    tables = {
        "nation": "SELECT id AS n_nationkey, concat('N', id) AS n_name FROM range(2)",
        "customer": "SELECT nullif(id, 3) AS c_custkey, concat('M', id % 2) AS c_name, id % 3 AS c_nationkey, id * 3000.0D AS c_acctbal, 'SEG' AS c_mktsegment FROM range(5)",
        "orders": "SELECT id % 6 AS o_orderkey, nullif(id % 4, 3) AS o_custkey FROM range(8)",
        "part": "SELECT id % 3 AS p_partkey, concat('p', id) AS p_name, 'B' AS p_brand FROM range(4)",
        "supplier": "SELECT id % 2 AS s_suppkey, concat('s', id) AS s_name FROM range(3)",
        "lineitem": "SELECT nullif(id % 7, 5) AS l_orderkey, id % 4 AS l_partkey, id % 3 AS l_suppkey, id * 321.5D AS l_extendedprice, "
        "date_add(date'1999-01-01', int(id)) AS l_shipdate, if(id % 2 = 0, 'F', 'O') AS l_linestatus, nullif(id % 3, 2) / 10.0D AS l_discount FROM range(30)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
        views.table(spark, str(tmp_path), name).createOrReplaceTempView(name)
    want = spark.sql(views.with_ctes("SELECT * FROM payments_raw", views.VIEWS))
    got = views.view(spark, str(tmp_path), "payments_raw")
    assert got.columns == want.columns and plain(got) == plain(want) and got.count() > 20


def test_vendor_concentration_settles_payments_without_an_exchange(spark, monkeypatch):
    rows, plans = payments(spark), []
    want = vendor.with_vendor_ratios(vendor.vendor_totals(rows))
    for of, out in (("constituency", "max_constituency_share"), ("mp_name", "max_sponsor_share")):
        want = want.join(vendor.largest_share(rows, of, out), "vendor", "left")
    monkeypatch.setattr(vendor, "settle", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    got = vendor.vendor_concentration(rows)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_payments_read_the_lines_once(spark, tmp_path):
    def write(name, schema, *rows):
        spark.createDataFrame(list(rows), schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("nation", "n_nationkey int, n_name string", (1, "N"))
    write("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", (1, "C", 1, 5.0, "M"))
    write("orders", "o_orderkey long, o_custkey long", (1, 1), (2, 1))
    write("part", "p_partkey long, p_name string, p_brand string", (1, "P", "B"), (1, "Q", None))
    write("supplier", "s_suppkey long, s_name string", (1, "S"))
    lines = [(1, 0.1, 10.0), (1, 0.0, 20.0), (2, None, 1234.5), (2, 0.1, None), (None, 0.1, 1.0)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linestatus string, l_shipdate timestamp, l_discount double, l_extendedprice double"
    write("lineitem", schema, *((key, 1, 1, "F", None, discount, price) for key, discount, price in lines))
    got = views.view(spark, str(tmp_path), "payments_raw")
    want = {"₹10.00 ": 4, "₹20.00 ": 2, "₹ 1,234.50": 2, None: 4}
    assert {r["expenditure_amount"]: r["count"] for r in got.groupBy("expenditure_amount").count().collect()} == want
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
