"""Scored tables: confusion, classification and regression metrics, curves, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.operators.histograms import histogram
from tablewright.operators.running import RANGE, ranged_melt, running_totals


def ratio(a: Column, b: Column) -> Column:
    """a / b with 0 for an empty denominator."""
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion_counts(scored: DataFrame, actual: str = "actual", pred: str = "pred",
                     by: list[str] | None = None) -> DataFrame:
    """(by…, actual, pred, n): the only shuffle of the scored rows that class metrics need."""
    return (scored.select(*(by or []), F.col(actual).alias("actual"), F.col(pred).alias("pred"))
            .groupBy(*(by or []), "actual", "pred").agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(scored: DataFrame, actual: str = "actual", pred: str = "pred",
                     top: int | None = None) -> DataFrame:
    """(actual, pred, n, row_share) with every cell of the class square.

    With ``top`` only the most frequent actual classes are kept, on both axes. A null label is a class of its own.
    """
    counts = confusion_counts(scored, actual, pred)
    if top is None:
        classes = counts.select(F.explode(F.array("actual", "pred")).alias("c")).distinct()
    else:
        classes = top_classes(counts, top)
    # the names of the classes travel as one row; class × class is the asked-for matrix
    names = classes.agg(F.collect_list(F.struct("c")).alias("cs"))
    square = names.select(F.inline("cs").alias("actual"), "cs").select("actual", F.inline("cs").alias("pred"))
    full = square.join(counts.toDF("__a", "__p", "n"), F.col("actual").eqNullSafe(F.col("__a")) & F.col("pred").eqNullSafe(F.col("__p")),
                       "left").select("actual", "pred", F.coalesce("n", F.lit(0)).alias("n"))
    row = F.sum("n").over(W.partitionBy("actual"))
    return full.select("actual", "pred", "n", ratio(F.col("n"), row).alias("row_share"))


def top_classes(counts: DataFrame, k: int) -> DataFrame:
    """(c): the k most frequent actual classes, smaller label first on a tie."""
    return (counts.groupBy(F.col("actual").alias("c")).agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), "c").limit(k).select("c"))


def rows_of_top_classes(scored: DataFrame, k: int, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Rows whose actual class is among the k most frequent: a semi join on k rows."""
    keep = top_classes(confusion_counts(scored, actual, pred), k).withColumnRenamed("c", actual)
    return scored.join(F.broadcast(keep), actual, "left_semi")


def per_class_metrics(scored: DataFrame, actual: str = "actual", pred: str = "pred",
                      top: int | None = None) -> DataFrame:
    """(class, precision, recall, f1, support) of all classes, or of the ``top`` most frequent ones.

    False positives count within the shown classes only. Comes from the counts that occur, not from the square.
    """
    cells = confusion_counts(scored, actual, pred)
    if top is not None:
        keep = F.broadcast(top_classes(cells, top))  # at most ``top`` rows
        for side in ("actual", "pred"):
            cells = cells.join(keep, F.col(side).eqNullSafe(F.col("c")), "left_semi")
    hit = F.col("actual").eqNullSafe(F.col("pred"))
    rows = cells.groupBy(F.col("actual").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    both = (rows.withColumn("predicted", F.lit(0)).unionByName(cols.withColumns({"support": F.lit(0), "tp": F.lit(0)}))
            .groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "predicted")]))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return both.select(
        "class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def classification_metrics(scored: DataFrame, actual: str = "actual", pred: str = "pred",
                           by: list[str] | None = None) -> DataFrame:
    """(by…, accuracy, precision, recall, f1_score, sample_count): support-weighted, 0 where undefined."""
    by = by or []
    counts = confusion_counts(scored, actual, pred, by)
    hit = F.col("actual").eqNullSafe(F.col("pred"))
    # one pass over the count table: each cell tells its row's support and its column's predictions
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")))
    per_class = (counts.select(*by, F.inline(sides)).groupBy(*by, "class")
                 .agg(F.sum("support").alias("s"), F.sum("predicted").alias("q"), F.sum("tp").alias("tp")))
    p, r = ratio(F.col("tp"), F.col("q")), ratio(F.col("tp"), F.col("s"))
    total = F.sum("s")
    return per_class.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"), (F.sum(F.col("s") * p) / total).alias("precision"),
        (F.sum(F.col("s") * r) / total).alias("recall"),
        (F.sum(F.col("s") * ratio(2 * p * r, p + r)) / total).alias("f1_score"), total.alias("sample_count"))


def regression_metrics(scored: DataFrame, actual: str = "actual", pred: str = "pred",
                       by: list[str] | None = None) -> DataFrame:
    """(by…, mse, rmse, mae, r2_score, sample_count) in one aggregate, over rows that have both values."""
    a, e = F.col(actual).cast("double"), F.col(actual).cast("double") - F.col(pred).cast("double")
    out = scored.groupBy(*(by or [])).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(F.when(e.isNotNull(), a)).alias("__v"),
        F.count(e).alias("sample_count"))
    return out.select(
        *(by or []), "mse", F.sqrt("mse").alias("rmse"), "mae",
        F.when(F.col("__v") > 0, 1 - F.col("mse") / F.col("__v"))
        .otherwise(F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).alias("r2_score"), "sample_count")


def long_metrics(metrics: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row metric table."""
    names = [c for c in metrics.columns if c != "sample_count"]
    return metrics.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])))


def residual_summary(scored: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """One row (n, mean, std): residuals actual − predicted with their population deviation."""
    e = F.col(actual).cast("double") - F.col(pred).cast("double")
    return scored.agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"))


def residual_histogram(scored: DataFrame, actual: str = "actual", pred: str = "pred", bins: int = 30) -> DataFrame:
    residuals = scored.select((F.col(actual).cast("double") - F.col(pred).cast("double")).alias("residual"))
    return histogram(residuals, ["residual"], bins)


def calibration_curve(scored: DataFrame, prob: str = "prob", label: str = "actual", bins: int = 10) -> DataFrame:
    """(bin, mean_predicted, fraction_positive, n) over equal-width bins closed on the right; empty bins absent.

    For more than two classes give the top probability as ``prob`` and correctness as ``label``.
    """
    p = F.col(prob)
    inner = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    return (scored.groupBy(F.size(F.filter(inner, lambda e: e < p)).alias("bin"))
            .agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("fraction_positive"),
                 F.count(F.lit(1)).alias("n")))


def class_distribution(scored: DataFrame, actual: str = "actual", pred: str = "pred",
                       k: int | None = None) -> DataFrame:
    """(side, class, n): all classes, or the k most frequent ones, actual and predicted."""
    counts = confusion_counts(scored, actual, pred)
    parts = []
    for side in ("actual", "pred"):
        sums = counts.groupBy(F.col(side).cast("string").alias("class")).agg(F.sum("n").alias("n"))
        if k is not None:
            sums = sums.orderBy(F.col("n").desc(), "class").limit(k)
        parts.append(sums.select(F.lit(side).alias("side"), "class", "n"))
    return parts[0].unionByName(parts[1])


def score_curve(scored: DataFrame, score: str = "prob", label: str = "actual") -> DataFrame:
    """(threshold, tp, fp, positives, negatives): totals of rows scored at or above each distinct score.

    Rows combine per score before the shuffle and the running totals go by score ranges, so
    a score shared by many rows or a continuous score costs no more than its distinct values.
    """
    y = F.col(label).cast("int")
    base = scored.select(F.col(score).cast("double").alias("threshold"), y.alias("y"))
    counted = (ranged_melt(base, ["threshold"], ["y"]).groupBy("column", RANGE, "value")
               .agg(F.sum("y").cast("bigint").alias("tp"), F.sum(1 - F.col("y")).cast("bigint").alias("fp")))
    totals = counted.agg(F.sum("tp").alias("positives"), F.sum("fp").alias("negatives"))
    running = running_totals(counted, "value", ["tp", "fp"], ["column"], descending=True)
    return running.crossJoin(F.broadcast(totals)).select(
        F.col("value").alias("threshold"), F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"),
        F.col("tp").alias("tp_step"), F.col("fp").alias("fp_step"), "positives", "negatives")


def roc_curve(scored: DataFrame, score: str = "prob", label: str = "actual") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score."""
    c = score_curve(scored, score, label)
    return c.select("threshold", F.try_divide("fp", "negatives").alias("fpr"),
                    F.try_divide("tp", "positives").alias("tpr"))


def auc(scored: DataFrame, score: str = "prob", label: str = "actual") -> DataFrame:
    """One row: area under the ROC curve. Each step adds its own trapezoid, so no ordering is needed."""
    c = score_curve(scored, score, label)
    area = F.sum(F.col("fp_step") * (F.col("tp") - F.col("tp_step") / 2.0))
    return c.agg(F.try_divide(area, F.max("positives") * F.max("negatives")).alias("auc"))


def precision_recall_curve(scored: DataFrame, score: str = "prob", label: str = "actual") -> DataFrame:
    """(threshold, precision, recall) for every distinct score."""
    c = score_curve(scored, score, label)
    return c.select("threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    F.try_divide("tp", "positives").alias("recall"))
