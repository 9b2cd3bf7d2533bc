"""Session settings the engine is designed for. On a cluster the submit-time settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "worklens", cores: int | str | None = None, **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if cores is not None:
        b = (
            b.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
        )
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
