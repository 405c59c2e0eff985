"""Pearson correlation, pairwise complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, numeric_columns, quoted
from tablewright.functions.labels import correlation_direction, correlation_strength
from tablewright.operators.gram import correlation, pair_moments
from tablewright.operators.summary import top_variance


def _named(names: list[str], at: str) -> Column:
    return F.get(F.array(*[F.lit(c) for c in names]), F.col(at))


def correlation_pairs(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(feature1, feature2, correlation) for i < j in column order; undefined pairs left out.

    One scan for all pairs, whatever their number.
    """
    cols = cols or numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, correlation double")
    moments = pair_moments(df, cols)
    found = moments.select(_named(cols, "i").alias("feature1"), _named(cols, "j").alias("feature2"), correlation(moments).alias("correlation"))
    return found.where(F.col("correlation").isNotNull())


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Both triangles and the diagonal, long form (feature1, feature2, correlation)."""
    cols = cols or numeric_columns(df)
    upper = correlation_pairs(df, cols)
    rows = F.array(
        F.struct("feature1", "feature2", "correlation"),
        F.struct(F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), F.col("correlation")))
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols],
                                               "feature1 string, feature2 string, correlation double")
    return upper.select(F.inline(rows)).unionByName(diagonal)


def top_correlations(df: DataFrame, k: int = 10, cols: list[str] | None = None) -> DataFrame:
    r = F.col("correlation")
    return (correlation_pairs(df, cols)
            .orderBy(F.abs(r).desc(), "feature1", "feature2").limit(k)
            .withColumn("strength", correlation_strength(r))
            .withColumn("direction", correlation_direction(r)))


def high_correlations(df: DataFrame, threshold: float = 0.8, cols: list[str] | None = None) -> DataFrame:
    return correlation_pairs(df, cols).where(F.abs("correlation") > threshold)


def correlation_with_target(df: DataFrame, target: str, k: int = 3, cols: list[str] | None = None) -> DataFrame:
    """The k columns of largest |r| with the target; the target itself takes part with 1."""
    cols = cols or numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, abs_correlation double")
    moments = pair_moments(df, cols, [target])
    return (moments.select(_named(cols, "i").alias("column"), F.abs(correlation(moments)).alias("abs_correlation"))
            .where(F.col("abs_correlation").isNotNull())
            .orderBy(F.col("abs_correlation").desc(), "column").limit(k))


def correlation_of_most_variable(df: DataFrame, k: int = 15, threshold: float = 0.7) -> DataFrame:
    """Highly correlated pairs among the k columns of largest variance (k column names are fetched)."""
    keep = {r["column"] for r in top_variance(df, k).collect()}
    cols = [c for c in numeric_columns(df) if c in keep]
    return high_correlations(df, threshold, cols)


def scatter_samples(df: DataFrame, key: str, pairs: int = 3, sample: int = 500,
                    cols: list[str] | None = None) -> DataFrame:
    """(feature1, feature2, correlation, x, y): a fixed sample of points for the strongest pairs.

    The sample is the rows of smallest md5(key), a repeatable stand-in for a random draw,
    taken by TakeOrdered and therefore without a full sort.
    """
    best = top_correlations(df, pairs, cols).select("feature1", "feature2", "correlation").collect()
    out = None
    for r in best:
        a, b = r["feature1"], r["feature2"]
        points = (df.select(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"),
                            F.lit(r["correlation"]).alias("correlation"),
                            as_double(df, a).alias("x"), as_double(df, b).alias("y"),
                            F.md5(quoted(key).cast("string")).alias("__h"))
                  .where(F.col("x").isNotNull() & F.col("y").isNotNull())
                  .orderBy("__h", "x", "y").limit(sample).drop("__h"))
        out = points if out is None else out.unionByName(points)
    return out
