"""Counts, shares, modes and contingency of categorical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import categorical_columns, is_missing, numeric_columns, quoted
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.summary import moments, value_table


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """(value, n) by descending count, value breaking ties; nulls left out."""
    counted = df.where(~is_missing(df, col)).groupBy(quoted(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted if k is None else counted.orderBy(F.col("n").desc(), "value").limit(k)


def top_values(df: DataFrame, k: int = 10, cols: list[str] | None = None,
               values: DataFrame | None = None) -> DataFrame:
    """(column, value, n, rank) for the k most frequent values of each column."""
    cols = cols or categorical_columns(df)
    counted = values if values is not None else value_table(df, cols)
    order = W.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def value_shares(df: DataFrame, col: str, of_all_rows: bool = False) -> DataFrame:
    """(value, n, share): of the non-null rows, or of all rows when ``of_all_rows``."""
    total = df.agg(F.count(F.lit(1) if of_all_rows else F.when(~is_missing(df, col), 1)).alias("__total"))
    return (value_counts(df, col).crossJoin(F.broadcast(total))
            .select("value", "n", (F.col("n") / F.col("__total")).alias("share")))


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mode, n): most frequent value, the smallest one on a tie (string order)."""
    order = W.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return (value_table(df, cols).withColumn("__r", F.row_number().over(order)).where("__r = 1")
            .select("column", F.col("value").alias("mode"), "n"))


def typed_mode(df: DataFrame, col: str) -> DataFrame:
    """One row (mode, n) in the column's own type and order."""
    return value_counts(df, col, 1).withColumnRenamed("value", "mode")


def crosstab(df: DataFrame, col: str, target: str) -> DataFrame:
    """(category, target, n, row_pct): contingency with row percentages, absent cells as 0."""
    filled = df.where(~is_missing(df, col) & ~is_missing(df, target))
    cells = (filled.groupBy(quoted(col).alias("category"), quoted(target).alias("target"))
             .agg(F.count(F.lit(1)).alias("n")))
    # the target is a class column: its few names travel as one row and open the absent cells
    classes = cells.agg(F.collect_set("target").alias("__classes"))
    full = (cells.select("category").distinct().join(F.broadcast(classes), F.lit(True))
            .select("category", F.explode("__classes").alias("target")))
    per_row = W.partitionBy("category")
    return (full.join(cells, ["category", "target"], "left").fillna({"n": 0})
            .withColumn("row_pct", F.col("n") * 100.0 / F.sum("n").over(per_row)))


def crosstab_wide(df: DataFrame, col: str, target: str, classes: list) -> DataFrame:
    """Row percentages with one column per class (classes given, so pivot needs no extra job)."""
    return (crosstab(df, col, target).groupBy("category").pivot("target", classes)
            .agg(F.first("row_pct")).fillna(0.0))


def by_target(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """(target, column, n, mean, std, median) of numeric columns per class."""
    cols = cols or [c for c in numeric_columns(df) if c != target]
    filled = df.where(~is_missing(df, target)).withColumn("target", quoted(target))
    m = moments(filled, cols, ["target"]).select("target", "column", "n", "mean", "std")
    q = exact_quantiles(filled, cols, {"median": 0.5}, ["target"]).drop("n")
    return m.join(q, ["target", "column"])


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, smallest and largest class, balance (min/max, %) and imbalance (max/min)."""
    return (value_counts(df, target)
            .agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_class"), F.max("n").alias("max_class"))
            .withColumn("balance_pct", F.col("min_class") * 100.0 / F.col("max_class"))
            .withColumn("imbalance_ratio", F.col("max_class") / F.col("min_class")))


def share_of_total(counted: DataFrame, value: str) -> DataFrame:
    """Adds share = value / total of a small report table (a pie)."""
    total = counted.agg(F.sum(value).alias("__t"))
    return counted.crossJoin(F.broadcast(total)).withColumn("share", F.col(value) / F.col("__t")).drop("__t")


def category_changes(reference: DataFrame, current: DataFrame, col: str) -> DataFrame:
    """(value, ref_n, cur_n, status): new / vanished / common categories of two frames."""
    tagged = (reference.select(quoted(col).alias("value"), F.lit(1).alias("r"), F.lit(0).alias("c"))
              .unionByName(current.select(quoted(col).alias("value"), F.lit(0).alias("r"), F.lit(1).alias("c"))))
    return (tagged.where(F.col("value").isNotNull()).groupBy("value")
            .agg(F.sum("r").alias("ref_n"), F.sum("c").alias("cur_n"))
            .withColumn("status", F.when(F.col("ref_n") == 0, "new").when(F.col("cur_n") == 0, "vanished")
                        .otherwise("common")))
