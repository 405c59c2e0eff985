"""Per-column statistics: moments, quantiles, nulls, distinct counts, shape, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import (as_double, is_missing, kind_of, melt, numeric_columns, present, quoted,
                                           stats_rows)
from tablewright.functions.labels import distribution_label
from tablewright.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_rows, nulls, null_pct)."""
    def stats(d: DataFrame, c: str) -> list[Column]:
        nulls = F.count_if(is_missing(d, c))
        return [F.count(F.lit(1)).alias("n_rows"), nulls.alias("nulls"),
                F.try_divide(nulls * 100.0, F.count(F.lit(1))).alias("null_pct")]
    return stats_rows(df, cols or df.columns, stats)


def completeness(df: DataFrame) -> DataFrame:
    """One row: share of filled cells in percent."""
    return (null_counts(df)
            .agg(F.sum("nulls").alias("missing_cells"), F.sum("n_rows").alias("cells"))
            .select("missing_cells", "cells",
                    ((1 - F.try_divide(F.col("missing_cells"), F.col("cells"))) * 100).alias("completeness_pct")))


def moments(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(column, n, mean, std, min, max); std is the sample one."""
    def stats(d: DataFrame, c: str) -> list[Column]:
        v = as_double(d, c)
        return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max")]
    return stats_rows(df, cols or numeric_columns(df), stats, by)


def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n, mean, std, min, max, q25, median, q75); nulls where a column is empty."""
    cols = cols or numeric_columns(df)
    quantiles = exact_quantiles(df, cols, QUARTILES).drop("n")
    return moments(df, cols).join(F.broadcast(quantiles), "column", "left")


def value_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) with values as strings, nulls left out: the one shuffle that
    distinct counts, top values, modes and class balance are all read from."""
    return melt(df, cols, to="string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, n_unique). Exact by a two-level count (no Expand over count-distincts);
    ``approximate`` keeps one HyperLogLog sketch per column and shuffles no values."""
    cols = cols or df.columns
    if approximate:
        return stats_rows(df, cols, lambda d, c: [F.approx_count_distinct(present(d, c)).alias("n_unique")])
    counted = value_table(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    return _complete(df, cols, counted, {"n_unique": 0})


def _complete(df: DataFrame, cols: list[str], stats: DataFrame, defaults: dict) -> DataFrame:
    """Adds rows for columns that had no value at all."""
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return F.broadcast(names).join(stats, "column", "left").fillna(defaults)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, repeats. Nulls compare equal."""
    groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
    ).withColumn("duplicate_rows", F.col("n_rows") - F.col("n_distinct"))


def entity_count(df: DataFrame, entities: list[str]) -> DataFrame:
    """One row: number of distinct entity tuples, null keys counted as a value."""
    return df.groupBy(*entities).agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("entity_count"))


def shape(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n, skewness, kurtosis): bias-corrected, kurtosis in excess of normal."""
    def stats(d: DataFrame, c: str) -> list[Column]:
        v = as_double(d, c)
        return [F.count(v).alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")]
    n = F.col("n").cast("double")
    flat = F.col("g1").isNull() | F.isnan("g1")
    return stats_rows(df, cols or numeric_columns(df), stats).select(
        "column", "n",
        F.when((n <= 2) | flat, 0.0).otherwise(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when((n <= 3) | flat, 0.0).otherwise(
            (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"))


def distributions(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Summary, inter-quartile range, shape and a distribution label per numeric column."""
    cols = cols or numeric_columns(df)
    return (numeric_summary(df, cols).join(F.broadcast(shape(df, cols).drop("n")), "column")
            .where(F.col("n") > 0)
            .withColumn("iqr", F.col("q75") - F.col("q25"))
            .withColumn("distribution_type", distribution_label(F.col("skewness"))))


def percentiles(df: DataFrame, cols: list[str], probs: dict[str, float]) -> DataFrame:
    return exact_quantiles(df, cols, probs)


def box_plots(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Five numbers, outlier bounds and the fences clamped to the data."""
    s = numeric_summary(df, cols).where(F.col("n") > 0)
    iqr = F.col("q75") - F.col("q25")
    return (s.withColumn("lower_bound", F.col("q25") - 1.5 * iqr)
            .withColumn("upper_bound", F.col("q75") + 1.5 * iqr)
            .withColumn("lower_fence", F.greatest("min", "lower_bound"))
            .withColumn("upper_fence", F.least("max", "upper_bound")))


def outliers_iqr(df: DataFrame, cols: list[str] | None = None, box: DataFrame | None = None) -> DataFrame:
    """(column, n, outliers, outlier_pct, lower_bound, upper_bound) by the 1.5·IQR rule."""
    cols = cols or numeric_columns(df)
    bounds = (box if box is not None else box_plots(df, cols)).select("column", "lower_bound", "upper_bound")
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return (melt(df, cols).join(F.broadcast(bounds), "column")
            .groupBy("column", "lower_bound", "upper_bound")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("outliers"))
            .withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("n")))


def variances(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return stats_rows(df, cols or numeric_columns(df),
                      lambda d, c: [F.var_samp(as_double(d, c)).alias("variance")])


def top_variance(df: DataFrame, k: int, cols: list[str] | None = None) -> DataFrame:
    """The k columns of largest variance."""
    return variances(df, cols).orderBy(F.col("variance").desc_nulls_last(), "column").limit(k)


def high_variance_count(df: DataFrame, cols: list[str], factor: float = 10.0) -> DataFrame:
    """One row: how many columns vary more than ``factor`` × the median variance."""
    v = variances(df, cols)  # one row per column: the median over it is small by schema
    m = v.agg(F.percentile("variance", 0.5).alias("median_variance"))
    return (v.crossJoin(F.broadcast(m))
            .agg(F.first("median_variance").alias("median_variance"),
                 F.count_if(F.col("variance") > F.col("median_variance") * factor).alias("high_variance_features")))


def zscore_anomalies(df: DataFrame, reference: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(column, n, anomalies, max_z) of df against (column, mean, std) rows of ``reference``."""
    cols = [c for c in numeric_columns(df)]
    ref = reference.where(F.col("std") > 0).select("column", F.col("mean").alias("mu"), F.col("std").alias("sigma"))
    z = F.abs((F.col("value") - F.col("mu")) / F.col("sigma"))
    return (melt(df, cols).join(F.broadcast(ref), "column")
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(z > threshold).alias("anomalies"), F.max(z).alias("max_z")))


def text_lengths(df: DataFrame, cols: list[str]) -> DataFrame:
    return stats_rows(df, cols, lambda d, c: [F.max(F.length(quoted(c))).cast("long").alias("max_length")])


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a frame: row count, xor and sum of the row hashes."""
    h = F.xxhash64(*[quoted(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"),
                  F.sum(h.cast(T.DecimalType(38, 0))).alias("sum_hash"))


def type_counts(df: DataFrame) -> dict[str, int]:
    out = {"numeric": 0, "categorical": 0, "datetime": 0, "other": 0}
    for f in df.schema.fields:
        out[kind_of(f.dataType)] += 1
    return out
