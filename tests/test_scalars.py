import datetime as dt

from pyspark.sql import functions as F

from worklens.functions import scalars as s
from worklens.params import PUBLISHED, Params
from worklens.plans.risk import category_of, with_final_score


def _one(spark, schema, rows, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_currency_literals(spark):
    texts = ["₹10,976,847.00", "₹ 1,50,000", "5000", None, "", "n/a", "NaN", "1e3", "12f"]
    got = _one(spark, "t string", [(t,) for t in texts], a=s.money(F.col("t")), b=s.money(F.col("t"), missing=0))
    assert [a for a, _ in got] == [10976847.0, 150000.0, 5000.0, None, None, None, None, 1000.0, None]
    assert [b for _, b in got] == [10976847.0, 150000.0, 5000.0, 0.0, 0.0, 0.0, 0.0, 1000.0, 0.0]


def test_date_literals(spark):
    rows = [("2023-05-10", "2023-08-15"), ("2023-05-10", "2022-01-01"), ("2023-05-10", None), ("bad", "2023-01-01")]
    d = F.datediff(s.iso_date(F.col("b")), s.iso_date(F.col("a")))
    assert [r[0] for r in _one(spark, "a string, b string", rows, d=d)] == [97, -494, None, None]


def test_offsets_are_turned_to_utc(spark):
    rows = [("2023-05-10T00:30:00+05:30",), ("2023-05-10T00:30:00Z",), ("2023-05-10T23:30:00-02:00",), ("2023-05-10 23:59:59",)]
    got = [r[0] for r in _one(spark, "t string", rows, d=s.iso_date(F.col("t")))]
    assert got == [dt.date(2023, 5, 9), dt.date(2023, 5, 10), dt.date(2023, 5, 11), dt.date(2023, 5, 10)]


def test_rounding_is_half_even(spark):
    got = _one(spark, "x double", [(0.125,), (0.375,), (2.5,), (None,)], two=s.rounded(F.col("x"), 2), none=s.rounded(F.col("x"), 0))
    assert got == [(0.12, 0.0), (0.38, 0.0), (2.5, 2.0), (None, None)]


def test_text_cleaning(spark):
    rows = [("  Étion—CC Road, #12!\n",), (None,), ("...",)]
    c = F.col("t")
    got = _one(spark, "t string", rows, a=s.clean_text(c), n=s.char_count(c), w=s.word_count(c))
    assert got == [("étion cc road 12", 22, 3), ("", 0, 0), ("", 3, 1)]


def test_clip_keeps_null_and_flags_treat_null_as_false(spark):
    got = _one(spark, "x double", [(-1.0,), (0.5,), (9.0,), (None,)], c=s.clip(F.col("x"), 0.0, 1.0), f=s.flag(F.col("x") > 0))
    assert got == [(0.0, 0), (0.5, 1), (1.0, 1), (None, 0)]


def test_full_components_give_100(spark):
    names = ["financial_score", "temporal_score", "isolation_forest_score", "vendor_score", "mp_works_risk_score"]
    df = spark.createDataFrame([(100.0,) * 5], ", ".join(f"{n} double" for n in names))
    row = with_final_score(df).first()
    assert row["final_risk_score"] == 100.0 and row["risk_category"] == "HIGH"


def test_categories_by_preset(spark):
    df = spark.createDataFrame([(20.0,), (55.0,), (85.0,), (39.99,), (40.0,), (49.99,), (50.0,)], "s double")
    published = [r[0] for r in df.select(category_of(F.col("s"), PUBLISHED)).collect()]
    running = [r[0] for r in df.select(category_of(F.col("s"), Params())).collect()]
    assert published[:3] == ["LOW", "MEDIUM", "HIGH"]
    assert running == ["LOW", "HIGH", "HIGH", "LOW", "MEDIUM", "MEDIUM", "HIGH"]
