"""Feature statistics and stored baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import categorical_columns, numeric_columns
from tablewright.operators.categories import top_values
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.summary import distinct_counts, moments, shape, value_table

PERCENTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def feature_statistics(df: DataFrame, *features: str) -> DataFrame:
    """One row per numeric feature: moments, percentiles, skewness and kurtosis."""
    cols = list(features) or numeric_columns(df)
    return (moments(df, cols).join(F.broadcast(exact_quantiles(df, cols, PERCENTILES).drop("n")), "column")
            .join(F.broadcast(shape(df, cols).drop("n")), "column"))


def baseline_numeric(df: DataFrame) -> DataFrame:
    """Moments, percentiles and distinct counts of the numeric columns, to be stored with a model."""
    cols = numeric_columns(df)
    return feature_statistics(df, *cols).join(F.broadcast(distinct_counts(df, cols)), "column")


def baseline_shares(df: DataFrame, k: int = 20, cols: list[str] | None = None) -> DataFrame:
    """(column, value, n, rank, share): the k most frequent categories with their share of the non-null rows."""
    cols = cols or categorical_columns(df)
    values = value_table(df, cols)
    totals = values.groupBy("column").agg(F.sum("n").alias("__t"))
    return (top_values(df, k, cols, values).join(F.broadcast(totals), "column")
            .withColumn("share", F.col("n") / F.col("__t")).drop("__t"))
