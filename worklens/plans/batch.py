"""The full batch run: ordered stages over stage tables, with the time of each stage."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.operators import iforest, quality
from worklens.params import Params
from worklens.plans import baselines, clean, financial, master, matrix, risk
from worklens.sources.staging import settle


def analysed(
    works: DataFrame, payments: DataFrame, sponsors: DataFrame, p: Params = Params(), featured: DataFrame | None = None
) -> tuple[DataFrame, dict]:
    """Works with all features, cohort benchmarks, model inputs filled in and sponsor metrics.

    ``raw_amount`` keeps the amount as recorded; ``effective_amount`` becomes the model's filled input.
    """
    if featured is None:
        df = settle(unfilled(works, payments, sponsors, p), "unfilled")
        fill = matrix.fit_fills(df)
    else:
        fill = matrix.fit_fills(featured)
        df = risk.with_sponsor_metrics(baselines.with_baseline(featured, p), sponsors)
    return filled(df, fill), fill


def unfilled(works: DataFrame, payments: DataFrame, sponsors: DataFrame, p: Params = Params()) -> DataFrame:
    """Works with all features, cohort benchmarks and sponsor metrics, before model inputs are filled in.

    Wide rows are shuffled twice: to their cost ranks, that in the cohort among them, and to their sponsor, for all it is asked for.
    """
    source = financial.with_effective_amount(works)
    sizes = baselines.cohort_sizes(works)
    featured = matrix.with_all_features(works, payments, sponsors, p, sizes)
    return risk.with_sponsor_metrics(baselines.with_baseline(featured, p, source, sizes), sponsors)


def filled(unfilled_works: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Model inputs filled in from the row alone, so that the wide rows needn't be stored again for it."""
    df = unfilled_works.withColumn("raw_amount", F.col("effective_amount"))
    df = quality.impute(matrix.pre_imputation(df), fill)
    first, last = ["mp_name", "constituency"], risk.SPONSOR_METRICS
    middle = [c for c in df.columns if c not in first and c not in last]
    return df.select(*first, *middle, *last)


def scored(analysed_works: DataFrame, p: Params = Params()) -> DataFrame:
    """Risk score and evidence, once the model's columns are there."""
    return risk.with_risk(analysed_works.withColumn("effective_amount", F.col("raw_amount")), p)


RUN_TABLE = "position int, stage string, status string, rows bigint, seconds double, error string"


@dataclass
class Run:
    """Results of a batch run: its tables, and one entry per stage begun in ``log``, failed ones too."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    log: list[tuple] = field(default_factory=list)
    forest: iforest.Forest | None = None
    failure: Exception | None = None

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """An error ends the run here; finished stages stay available."""
        began = time.monotonic()
        try:
            self.tables[name] = settle(make(), name)
        except Exception as e:
            self.log.append((len(self.log), name, "failed", None, time.monotonic() - began, f"{type(e).__name__}: {e}"[:500]))
            self.failure = e
            raise
        rows = self.tables[name].count()
        self.log.append((len(self.log), name, "done", rows, time.monotonic() - began, None))
        return self.tables[name]

    @property
    def timings(self) -> list[tuple[str, float]]:
        return [(entry[1], entry[4]) for entry in self.log]

    def report(self, spark: SparkSession) -> DataFrame:
        """The run table: one row per stage."""
        return spark.createDataFrame(self.log, RUN_TABLE)


def full_run(
    raw_recommended: DataFrame,
    raw_completed: DataFrame,
    raw_payments: DataFrame,
    raw_sponsors: DataFrame,
    p: Params = Params(),
    stop: bool = True,
) -> Run:
    """All stages in order. With ``stop=False`` a failing stage ends the run without an error; the run table tells."""
    run = Run()
    try:
        _stages(run, raw_recommended, raw_completed, raw_payments, raw_sponsors, p)
    except Exception:
        if stop or run.failure is None:
            raise
    return run


def _stages(run: Run, raw_recommended: DataFrame, raw_completed: DataFrame, raw_payments: DataFrame, raw_sponsors: DataFrame, p: Params) -> None:
    works = run.stage(
        "works",
        lambda: clean.unify_works(clean.clean_recommended(raw_recommended), clean.clean_completed(raw_completed), p),
    )
    payments = run.stage("payments", lambda: clean.clean_payments(raw_payments, p))
    sponsors = run.stage("sponsors", lambda: clean.clean_sponsors(raw_sponsors))
    featured = run.stage("features", lambda: matrix.with_all_features(works, payments, sponsors, p))
    dictionary = run.stage("dictionary", lambda: matrix.feature_dictionary(featured))
    ready = run.stage("analysed", lambda: analysed(works, payments, sponsors, p, featured)[0])
    features = matrix.model_features(dictionary)  # the dictionary decides what the model sees
    quality.require_clean(ready, features)

    def model() -> DataFrame:
        run.forest, out = iforest.detect(ready, features, p)
        return out

    flagged = run.stage("model", model)
    run.stage("scored", lambda: scored(flagged, p))
    run.stage("master", lambda: master.master_table(run.tables["scored"], p))
