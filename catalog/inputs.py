"""Cleaned inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import view
from worklens.functions.scalars import rounded
from worklens.params import Params
from worklens.plans import batch, clean, matrix
from worklens.plans.master import master_table
from worklens.sources.staging import settle_once

#: The shared tables cover 1995-2001, so the year parameters point there.
P = Params(covid_years=(1998, 1999), works_years=(1999, 2000), payment_years=(2000, 2001))


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A raw view under the column titles of the published files."""
    titles = {
        "payments_raw": clean.PAYMENT_TITLES,
        "recommended_raw": clean.RECOMMENDED_TITLES,
        "completed_raw": clean.COMPLETED_TITLES,
        "sponsor_raw": clean.SPONSOR_TITLES,
    }[name]
    return view(spark, sf, name).withColumnsRenamed({short: title for title, short in titles.items()})


def payments(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_payments(raw(spark, sf, "payments_raw"), P)


def works(spark: SparkSession, sf: str) -> DataFrame:
    recommended = clean.clean_recommended(raw(spark, sf, "recommended_raw"))
    completed = clean.clean_completed(raw(spark, sf, "completed_raw"))
    return clean.unify_works(recommended, completed, P)


def sponsors(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_sponsors(raw(spark, sf, "sponsor_raw"))


def settled_works(spark: SparkSession, sf: str) -> DataFrame:
    return settle_once(spark, ("works", sf), lambda: works(spark, sf))


def settled_payments(spark: SparkSession, sf: str) -> DataFrame:
    return settle_once(spark, ("payments", sf), lambda: payments(spark, sf))


def settled_sponsors(spark: SparkSession, sf: str) -> DataFrame:
    return settle_once(spark, ("sponsors", sf), lambda: sponsors(spark, sf))


def tidy(df: DataFrame, columns: str, places: int = 6) -> DataFrame:
    """Round the listed columns, to take out the last-digit noise of summing order."""
    return df.withColumns({c: rounded(F.col(c), places) for c in columns.split()})


def given_scores(df: DataFrame) -> DataFrame:
    """Model columns computed from the amount, so that SQL can compute them too."""
    part = F.coalesce(F.col("raw_amount"), F.lit(0.0))
    df = df.withColumn("normalized_anomaly_score", rounded(part / (part + 100000.0), 6))
    df = df.withColumn("raw_anomaly_score", rounded(0.2 - 0.3 * F.col("normalized_anomaly_score"), 6))
    below = F.col("raw_anomaly_score") < 0
    return df.withColumns({"is_anomaly": below.cast("int"), "anomaly_label": F.when(below, -1).otherwise(1)})


def analysed_works(spark: SparkSession, sf: str) -> DataFrame:
    """Works with features, benchmarks and given model scores. What needs other rows is settled once per session, and so are the fills."""

    def make() -> DataFrame:
        return batch.unfilled(settled_works(spark, sf), settled_payments(spark, sf), settled_sponsors(spark, sf), P)

    df = settle_once(spark, ("unfilled", sf), make)

    def fills() -> DataFrame:
        rows = [F.struct(F.lit(name).alias("feature"), F.lit(fill).alias("fill")) for name, fill in matrix.fit_fills(df).items()]
        return spark.range(1).select(F.inline(F.array(*rows)))

    kept = settle_once(spark, ("fills", sf), fills)
    return given_scores(batch.filled(df, {row["feature"]: row["fill"] for row in kept.collect()}))


def scored_works(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and evidence come from a work's own columns, so they are computed where they are read and never stored."""
    return batch.scored(analysed_works(spark, sf), P)


def master(spark: SparkSession, sf: str) -> DataFrame:
    return master_table(scored_works(spark, sf), P)
