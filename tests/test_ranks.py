import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from worklens.functions import ranks
from worklens.operators import cohorts
from worklens.params import Params
from worklens.plans import baselines


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value most of that group; negatives, repeats and nulls included."""
    rng = np.random.default_rng(5)
    g = np.where(rng.random(4000) < 0.7, "hot", rng.choice(list("abcdef"), 4000))
    v = np.round(rng.lognormal(9, 2, 4000) - 500, 2)
    v[rng.random(4000) < 0.4] = 1234.5
    pdf = pd.DataFrame({"g": g, "v": v})
    pdf.loc[rng.random(4000) < 0.05, "v"] = np.nan
    pdf.loc[rng.random(4000) < 0.02, "g"] = None
    rows = [(None if pd.isna(a) else a, None if pd.isna(b) else float(b)) for a, b in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "g string, v double").repartition(7)


def test_textbook_ranks(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 9.0)], "g string, v double")
    got = {r["v"]: r["p"] for r in ranks.percentile_ranks(df, ["g"], "v", "p").collect()}
    assert got == {1.0: 25.0, 2.0: 62.5, 9.0: 100.0}


def test_ranks_match_pandas(skewed):
    pdf, df = skewed
    want = pdf.dropna().assign(p=lambda x: x.groupby("g")["v"].rank(pct=True) * 100).drop_duplicates()
    got = ranks.percentile_ranks(df, ["g"], "v", "p").toPandas()
    both = want.merge(got, on=["g", "v"], how="outer")
    assert len(both) == len(got) and np.allclose(both["p_x"], both["p_y"], rtol=1e-12)


@pytest.mark.parametrize("bucket", [ranks.MONEY, ranks.ANY, ranks.even_bucket(1e6), ranks.even_bucket(0.5)])
def test_quantiles_match_numpy_for_any_bucket(skewed, bucket):
    pdf, df = skewed
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["g"]: r for r in ranks.group_quantiles(df, ["g"], "v", points, bucket).collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert np.allclose([got[g][k] for k in points], np.quantile(part["v"], list(points.values())))


def test_whole_column_quantile(skewed):
    pdf, df = skewed
    assert ranks.quantiles(df, "v", {"m": 0.5}).first()["m"] == pytest.approx(pdf["v"].median())


def test_share_below_matches_brute_force(spark, skewed):
    pdf, df = skewed
    asked = [("hot", 1234.5), ("hot", -1e9), ("a", 700.0), ("b", 1e12), ("nowhere", 5.0)]
    got = {
        (r["g"], r["at"]): r["s"]
        for r in ranks.share_below(df, spark.createDataFrame(asked, "g string, at double"), ["g"], "v", "at", "s").collect()
    }
    clean = pdf.dropna()
    for g, at in asked[:-1]:
        assert got[(g, at)] == pytest.approx((clean[clean.g == g]["v"] < at).mean() * 100)
    assert got[("nowhere", 5.0)] is None


def test_group_gates(spark):
    rows = [("nine", float(i)) for i in range(9)] + [("ten", float(i)) for i in range(10)]
    rows += [("flat", 5.0)] * 12 + [(None, 1.0)] * 12 + [("gone", None)] * 12
    df = spark.createDataFrame(rows, "g string, v double")
    z = cohorts.with_z_score(df, "g", "v", "z", Params()).groupBy("g").agg(F.count("z").alias("n"))
    assert {r["g"]: r["n"] for r in z.collect()} == {"nine": 0, "ten": 10, "flat": 0, None: 0, "gone": 0}
    p = cohorts.with_percentile(df, "g", "v", "p", 10).groupBy("g").agg(F.count("p").alias("n"))
    assert {r["g"]: r["n"] for r in p.collect()} == {"nine": 0, "ten": 10, "flat": 12, None: 0, "gone": 0}


def test_cohort_choice_and_lonely_cohort(spark):
    rows = [(i, "big", "c1", "s1", 100.0 + i) for i in range(10)]
    rows += [(20 + i, "small", "c2", "s1", 5.0) for i in range(10)]
    rows += [(40, None, "c3", "s9", 7.0), (41, "rare", None, "s8", None)]
    df = spark.createDataFrame(rows, "work_id long, category string, constituency string, state string, effective_amount double")
    df = df.withColumn("project_status", F.lit("x"))
    # "small" has ten works as well; drop one so that its works fall back to their constituency
    df = df.withColumn("category", F.when(F.col("work_id") == 29, F.lit(None)).otherwise(F.col("category")))
    got = {r["work_id"]: r for r in baselines.with_baseline(df).collect()}
    assert got[0]["baseline_group"] == "Category: big"
    assert got[20]["baseline_group"] == "Constituency: c2" == got[29]["baseline_group"]
    assert got[40]["baseline_group"] == "State: s9" and got[40]["percentile"] == 50.0 and got[40]["z_score"] == 0.0
    assert got[41]["z_score"] == 0.0 and got[41]["statistical_flag"] == 0
    assert got[20]["group_std"] == 0.0 and got[20]["z_score"] == 0.0


def test_row_numbers_of_one_instant_and_of_none(spark):
    """Most rows share a value or have none; every place is given once, in order."""
    rows = [(1, 5)] * 300 + [(None, 7)] * 50 + [(i, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = sorted((r.place, r.a, r.b) for r in ranks.row_numbers(df, ["a", "b"], "place").collect())
    assert [g[0] for g in got] == list(range(len(rows)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [g[1:] for g in got] == sorted(rows, key=key)
    assert ranks.row_numbers(df.limit(0), ["a"], "place").count() == 0


def test_quantiles_move_only_rows_of_their_buckets(spark):
    """The buckets that hold a quantile are few and of known size: no sort-merge join of all rows with them."""
    from worklens.functions.ranks import group_quantiles

    df = spark.range(2000).selectExpr("id % 3 AS g", "double(id) AS v")
    out = group_quantiles(df, ["g"], "v", {"m": 0.5})
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert {r.g: r.m for r in out.collect()} == {0: 999.0, 1: 1000.0, 2: 999.5}
