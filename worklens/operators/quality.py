"""Profiling and data-quality operators. Column-wise results come from one pass and one shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.functions.ranks import ANY, group_quantiles
from worklens.functions.scalars import finite, rounded

# Wording of the missingness classes.
COMPLETE = "Complete (0% missing)"
STRUCTURAL_OPEN = "Structural Missingness (Missing for uncompleted/recommended-only projects)"
STRUCTURAL_DONE = "Structural Missingness (Missing for completed-only projects)"
MNAR = "MNAR (Missing Not At Random - optional feedback/rating submission)"
MAR_CATEGORY = "MAR (Missing At Random - category unassigned during data entry)"
MCAR = "MCAR (Missing Completely At Random - sporadic missing text/description)"
MAR = "MAR (Missing At Random)"


def profile(df: DataFrame, dataset: str) -> DataFrame:
    """One row per column: type, rows, nulls, null percentage. NaN counts as missing, as the source does."""
    types = dict(df.dtypes)

    def missing(c: str) -> Column:
        col = F.col(f"`{c}`")
        return F.count_if(col.isNull() | F.isnan(col)) if types[c] in ("double", "float") else F.count_if(col.isNull())

    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[missing(c).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"), F.col(f"_m{i}").alias("null_count"))
            for i, c in enumerate(df.columns)
        ]
    )
    share = F.coalesce(F.try_divide(F.col("null_count").cast("double"), F.col("_rows").cast("double")), F.lit(0.0))
    return one.select("_rows", F.inline(entries)).select(
        F.lit(dataset).alias("dataset"),
        "column_name",
        "data_type",
        F.col("_rows").alias("total_rows"),
        "null_count",
        rounded(share * 100.0, 4).alias("null_percentage"),
    )


def with_missingness(profiles: DataFrame, unified: str = "projects_clean") -> DataFrame:
    """Class of missingness per profiled column; the first rule that fits wins."""
    col, works = F.col("column_name"), F.col("dataset") == unified
    kind = (
        F.when(F.col("null_count") == 0, COMPLETE)
        .when(works & col.isin("completed_date", "final_amount", "category", "average_rating"), STRUCTURAL_OPEN)
        .when(works & col.isin("recommended_amount", "recommendation_date"), STRUCTURAL_DONE)
        .when(col.isin("average_rating", "Average Rating"), MNAR)
        .when(col.isin("category", "Category"), MAR_CATEGORY)
        .when(F.col("null_percentage") < 1.0, MCAR)
        .otherwise(MAR)
    )
    return profiles.withColumn("missingness_classification", kind)


def exact_copies(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus copies."""
    sizes = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def key_repeats(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key was seen before; nothing is removed."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_keys")
    )


def long_form(df: DataFrame, columns: Iterable[str], ids: Iterable[str] = ()) -> DataFrame:
    """(ids, feature, value) with every value as double."""
    columns = list(columns)
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(ids), columns, "feature", "value")


def describe(df: DataFrame, columns: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """Usable, missing, mean, deviation, minimum, exact quartiles and maximum per feature."""
    by = list(by)
    rows = long_form(df, columns, by)
    keys = [*by, "feature"]
    basic = rows.groupBy(*keys).agg(
        F.count("value").alias("usable"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = group_quantiles(rows, keys, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ANY)
    return basic.join(quartiles, keys, "left")


def infinite_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    rows = long_form(df, columns)
    return rows.groupBy("feature").agg(F.count_if(F.abs("value") == float("inf")).alias("infinite"))


def without_infinite(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})


def fit_imputer(df: DataFrame, columns: Iterable[str], constants: dict[str, float]) -> dict[str, float]:
    """Fill value per column: a constant, else the exact median, all taken before anything is filled."""
    columns = list(columns)
    by_median = [c for c in columns if c not in constants]
    fill = {c: float(v) for c, v in constants.items() if c in columns}
    if by_median:
        medians = group_quantiles(long_form(df, by_median), ["feature"], "value", {"median": 0.5}, ANY)
        fill.update({row["feature"]: row["median"] for row in medians.collect()})  # one row per column
    return fill


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()})


def variances(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return long_form(df, columns).groupBy("feature").agg(F.var_samp("value").alias("variance"))


def flat_features(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    v = F.col("variance")
    return variances(df, columns).where(v.isNull() | F.isnan(v) | (v == 0)).select("feature")


def correlated_pairs(df: DataFrame, columns: Iterable[str], at_least: float = 0.85) -> DataFrame:
    """Feature pairs with |Pearson r| at or above the limit, from one distributed pass over the matrix.

    A pair uses every row in which both its values are known: a null or NaN costs the row for that pair only. A pair with a
    flat side has no correlation. Pairs are groups, not columns of one wide aggregate, which Spark would not compile.
    """
    columns = list(columns)

    def known(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(~F.isnan(value), value)

    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_1 string, feature_2 string, r double")
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    values = df.select(F.array(*[known(c) for c in columns]).alias("v"))
    sides = values.select(F.inline(every), "v").select("i", "j", F.get("v", F.col("i")).alias("x"), F.get("v", F.col("j")).alias("y"))
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    found = sides.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("i", "j").agg(r.alias("r"))
    rows = [(columns[t["i"]], columns[t["j"]], t["r"]) for t in found.collect() if t["r"] is not None and abs(t["r"]) >= at_least]  # a row per pair
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, r double")


def preflight(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Counts that must all be zero before a model is fitted."""
    columns = list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in columns if not isinstance(types[c], (T.NumericType, T.BooleanType))]
    numeric = [c for c in columns if c not in text]

    def cells(test) -> Column:
        return sum((F.count_if(test(F.col(c).cast("double"))) for c in numeric), F.lit(0)).cast("bigint")

    return df.agg(
        F.lit(len(text)).cast("bigint").alias("non_numeric_columns"),
        cells(lambda v: v.isNull() | F.isnan(v)).alias("null_cells"),
        cells(lambda v: F.abs(v) == float("inf")).alias("infinite_cells"),
    )


def require_clean(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    counts = preflight(df, columns).first().asDict()
    bad = {k: v for k, v in counts.items() if v}
    if bad:
        raise ValueError(f"the feature matrix is not ready for a model: {bad}")
    return df


def distinct_counts(df: DataFrame, columns: Iterable[str], approximate: bool = False) -> DataFrame:
    """Number of different values per column, exact unless asked otherwise."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "v")
    if approximate:
        return rows.groupBy("column_name").agg(F.approx_count_distinct("v").alias("distinct_values"))
    return rows.distinct().groupBy("column_name").agg(F.count("v").alias("distinct_values"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per value; the total comes from the counts, not from the rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("share_pct", rounded(F.col("rows") * 100.0 / total, 2))
