"""Trends of numeric columns over a time column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import datetime_columns, melt, numeric_columns, quoted
from tablewright.operators.drift import degradation


def resample(df: DataFrame, time: str | None = None, cols: list[str] | None = None) -> DataFrame:
    """(column, frequency, bucket, value): bucket means of all numeric columns or ``cols``, empty buckets absent.

    Over a year of data → months, over 30 days → weeks ending on Sunday, else days. The
    choice is made inside the plan from a one-row aggregate.
    """
    time = time or datetime_columns(df)[0]
    cols = cols or numeric_columns(df)
    day = quoted(time).cast("date")
    span = df.agg(((F.unix_micros(F.max(quoted(time)).cast("timestamp")) - F.unix_micros(F.min(quoted(time)).cast("timestamp")))
                   / 86_400_000_000).cast("bigint").alias("__days"))
    frequency = F.when(F.col("__days") > 365, "Monthly").when(F.col("__days") > 30, "Weekly").otherwise("Daily")
    bucket = (F.when(F.col("__days") > 365, F.last_day("__day"))
              .when(F.col("__days") > 30, F.next_day(F.date_sub("__day", 1), "SUN")).otherwise(F.col("__day")))
    long = melt(df.withColumn("__day", day).where(F.col("__day").isNotNull()), cols, ["__day"])
    # days first: the wide input shrinks to one row per day and column before the bucket is known
    daily = long.groupBy("column", "__day").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return (daily.crossJoin(F.broadcast(span))
            .groupBy("column", frequency.alias("frequency"), bucket.alias("bucket"))
            .agg((F.sum("s") / F.sum("n")).alias("value")))


def last_points(points: DataFrame, n: int = 50) -> DataFrame:
    """The last n buckets per column."""
    newest = W.partitionBy("column").orderBy(F.col("bucket").desc())
    return points.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= n).drop("__r")


def direction(points: DataFrame) -> DataFrame:
    """(column, frequency, first_value, last_value, trend_direction, change_pct)."""
    ends = points.groupBy("column", "frequency").agg(
        F.min_by("value", "bucket").alias("first_value"), F.max_by("value", "bucket").alias("last_value"))
    a, b = F.col("first_value"), F.col("last_value")
    return (ends.withColumn("trend_direction", F.when(b > a, "Increasing").otherwise("Decreasing"))
            .withColumn("change_pct", F.when(a != 0, (b - a) / F.abs(a) * 100).otherwise(0.0)))


HIGHER_IS_BETTER = ("accuracy", "precision", "recall", "f1_score", "r2_score")


def metric_trend(history: DataFrame, periods: int = 10) -> DataFrame:
    """(metric, slope, trend, current, min, max, mean, points) over the last ``periods`` snapshots.

    ``history`` is (metric, at, value). Fewer than two points give "unknown".
    """
    newest = W.partitionBy("metric").orderBy(F.col("at").desc())
    tail = (history.where(F.col("value").isNotNull())
            .withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= periods))
    out = tail.groupBy("metric").agg(
        F.count(F.lit(1)).alias("points"), F.regr_slope(F.col("value"), -F.col("__r").cast("double")).alias("slope"),
        F.max_by("value", "at").alias("current"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"))
    up = F.col("slope") > 0
    better = F.col("metric").isin(*HIGHER_IS_BETTER)
    trend = (F.when(F.col("points") < 2, "unknown").when(F.abs("slope") < 0.001, "stable")
             .when(up == better, "improving").otherwise("degrading"))
    return out.withColumn("trend", trend)


def performance_summary(baseline: DataFrame, history: DataFrame, periods: int = 10) -> DataFrame:
    """(metric, baseline, current, change_pct, degraded, points, slope, trend): the newest snapshot of every metric
    against its baseline (metric, value), with its trend over the last ``periods`` snapshots (metric, at, value)."""
    newest = history.where(F.col("value").isNotNull()).groupBy("metric").agg(F.max_by("value", "at").alias("value"))
    moved = degradation(baseline, newest).select("metric", "baseline", "current", "change_pct", "degraded")
    return moved.join(metric_trend(history, periods).select("metric", "points", "slope", "trend"), "metric", "left")
