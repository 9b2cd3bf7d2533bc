import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.operators import iforest
from worklens.params import Params

P = Params(trees=40)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    x[:15] += 12.0  # planted outliers
    x[1000:2000] = 0.25  # a third of all rows is identical
    return spark.createDataFrame([(i if i < 1000 or i >= 2000 else 1000, *map(float, r)) for i, r in enumerate(x)], "work_id int, a double, b double, c double")


@pytest.fixture(scope="module")
def found(points):
    return iforest.detect(points, ["a", "b", "c"], P)


def test_share_flags_and_severity(found):
    _, out = found
    row = out.agg(
        F.avg("is_anomaly"), F.min("normalized_anomaly_score"), F.max("normalized_anomaly_score"),
        F.count_if((F.col("raw_anomaly_score") < 0) != (F.col("anomaly_label") == -1)),
    ).first()
    assert abs(row[0] - P.contamination) < 0.01 and row[1] == 0.0 and row[2] == 1.0 and row[3] == 0


def test_planted_outliers_come_first(found):
    _, out = found
    top = out.orderBy("raw_anomaly_score").limit(15).select("work_id").collect()
    assert {r[0] for r in top} == set(range(15))


def test_layout_does_not_matter(points, found):
    want = {r[0]: r[1] for r in found[1].select("work_id", "raw_anomaly_score").collect()}
    for parts in (1, 4, 13):
        _, out = iforest.detect(points.repartition(parts), ["a", "b", "c"], P)
        got = {r[0]: r[1] for r in out.select("work_id", "raw_anomaly_score").collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_samples_are_bounded_and_weighted(points):
    sample = iforest.tree_samples(points, ["a", "b", "c"], [42], P)
    sizes = sample.groupBy("tree").agg(F.count("*").alias("n"), F.count_if(F.col("x")[0] == 0.25).alias("same")).collect()
    assert len(sizes) == P.trees and all(r["n"] == P.tree_rows for r in sizes)
    assert 0.25 < sum(r["same"] for r in sizes) / (P.trees * P.tree_rows) < 0.42


def test_saved_forest_scores_the_same(spark, points, found, tmp_path):
    forest, out = found
    iforest.save(forest, str(tmp_path / "m"))
    again = iforest.load(spark, str(tmp_path / "m")).score(points)
    assert again.agg(F.sum("is_anomaly")).first()[0] == out.agg(F.sum("is_anomaly")).first()[0]


def test_flag_sets_are_nested(points):
    from worklens.plans.evaluate import seed_stability

    rows = seed_stability(points, ["a", "b", "c"], P.but(stability_seeds=(42, 7), trees=20)).collect()
    assert [r["metric_type"] for r in rows].count("contamination_sensitivity") == 4
    flagged = [r["anomalies_flagged"] for r in rows if r["metric_type"] == "contamination_sensitivity"]
    assert flagged == sorted(flagged)
    kept = [r["std_score"] for r in rows if r["metric_type"] == "contamination_sensitivity"]
    assert kept == [100.0] * 4
    pair = next(r for r in rows if r["metric_type"] == "pairwise_stability")
    assert 0.5 < pair["spearman_rho_vs_baseline"] <= 1.0 and 0.0 < pair["jaccard_vs_baseline"] <= 1.0


def test_dirty_matrix_is_refused(spark):
    from worklens.operators.quality import require_clean

    with pytest.raises(ValueError, match="null_cells"):
        require_clean(spark.createDataFrame([(1.0,), (None,)], "a double"), ["a"])
