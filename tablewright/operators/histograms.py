"""Equal-width histograms with the edge rules of NumPy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, melt, numeric_columns, stats_rows


def bin_index(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of v; bins are closed on the left, the last one on both sides.

    The arithmetic guess is corrected against the edges lo + i·step, so a value that
    equals an edge lands right of it whatever the rounding of the division.
    """
    step = (hi - lo) / bins
    guess = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    down = F.when(v < lo + guess * step, 1).otherwise(0)
    up = F.when((v >= lo + (guess + 1) * step) & (guess != bins - 1), 1).otherwise(0)
    return guess - down + up


def ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, lo, hi) over all rows; an empty range is widened by ½ on both sides."""
    r = stats_rows(df, cols, lambda d, c: [F.min(as_double(d, c)).alias("lo"), F.max(as_double(d, c)).alias("hi")])
    r = r.where(F.col("lo").isNotNull())
    flat = F.col("lo") == F.col("hi")
    return r.select("column", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                    F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))


def grid(ranges_frame: DataFrame, bins: int) -> DataFrame:
    """(column, lo, hi, bin) with every bin present."""
    return ranges_frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 20) -> DataFrame:
    """(column, bin, bin_start, bin_end, n): two narrow scans, one small shuffle each."""
    cols = cols or numeric_columns(df)
    bounds = ranges(df, cols)
    counted = (
        melt(df, cols).join(F.broadcast(bounds), "column")
        .select("column", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")))
    step = (F.col("hi") - F.col("lo")) / bins
    return (
        grid(bounds, bins).join(counted, ["column", "bin"], "left")
        .select("column", "bin", (F.col("lo") + F.col("bin") * step).alias("bin_start"),
                (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_end"),
                F.coalesce("n", F.lit(0)).alias("n")))
