"""Regression trees fitted to counts of binned rows.

A tree of Spark sees of a feature only the bin between two of its candidate splits, and of the rows of one combination of
bins only how many there are and the sum of their labels: their squares add the same to the impurity before and after any
split. So rows are counted by combination in one aggregate, and the solver's many passes go over combinations, weighted by
their rows, with the mean label of each. There are no more of them than rows, and never more than the bins to the power
of the features. Candidate splits are chosen as Spark chooses them, from the rows that it draws; all rows are counted.
The solver is given numbers of bins; the splits of the fitted trees are put back into the numbers of the features.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows that Spark draws for candidate splits, at least
DRAWN = 10_000


def drawn_rows(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows that a solver of Spark draws for candidate splits, where it is given them in these partitions."""
    if share >= 1:
        return rows
    spark = rows.sparkSession
    at = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD().sample(False, share, at), rows._jdf.schema()), spark)


def candidate_splits(values: np.ndarray, most: int, expected: float) -> list[float]:
    """At most ``most`` numbers between values that lie next to each other, an equal share of the ``expected`` values apart.

    As in Spark, values that the sample has fewer of than expected count as zeros.
    """
    distinct, counts = np.unique(values[values != 0], return_counts=True)
    zeros = expected - counts.sum()
    if zeros > np.finfo(np.float64).eps * max(1, counts.sum()) * 100:
        at = np.searchsorted(distinct, 0.0)
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts.astype(np.float64), at, zeros)
    with np.errstate(invalid="ignore"):
        between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) > most:
        kept, stride = [], expected / (most + 1)
        current, target = counts[0], stride
        for i in range(1, len(distinct)):
            before, current = current, current + counts[i]
            if abs(before - target) < abs(current - target):
                kept.append(i - 1)
                target += stride
        between = between[kept]
    return between[np.isfinite(between)].tolist()


def bin_of(x: Column, splits: list[float], low: int = 0) -> Column:
    """How many splits lie below x, by halving; NaN lies above all."""
    if not splits:
        return F.lit(low)
    middle = len(splits) // 2
    return (F.when(x <= F.lit(splits[middle]), bin_of(x, splits[:middle], low))
            .otherwise(bin_of(x, splits[middle + 1:], low + middle + 1)))


def _with_splits(node, splits: list[list[float]], tree):
    """The node and those below it, with numbers of bins replaced by the splits after them."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node
    at = node.split()
    moved = tree.ContinuousSplit(at.featureIndex(), float(splits[at.featureIndex()][int(at.threshold())]))
    return tree.InternalNode(node.prediction(), node.impurity(), node.gain(), _with_splits(node.leftChild(), splits, tree),
                             _with_splits(node.rightChild(), splits, tree), moved, node.impurityStats())


def fit_binned(estimator: DecisionTreeRegressor | GBTRegressor, rows: DataFrame, ready: Callable[[DataFrame], DataFrame],
               features: int) -> DecisionTreeRegressionModel | GBTRegressionModel:
    """The estimator fitted to all of ``rows``, of which ``ready`` makes (features vector, label), one for one and without nulls."""
    spark = rows.sparkSession
    n = rows.count()
    most = estimator.getMaxBins()
    share = min(1.0, max(most * most, DRAWN) / max(n, 1))
    drawn = ready(drawn_rows(rows, share, estimator.getSeed())).select(vector_to_array("features").alias("x")).toPandas()["x"]
    drawn = np.array(drawn.tolist(), np.float64).reshape(-1, features)
    splits = [candidate_splits(drawn[:, j], max(1, min(most, n)) - 1, share * n) for j in range(features)]
    bins = [bin_of(F.get("x", F.lit(j)), s).cast("double").alias(f"b{j}") for j, s in enumerate(splits)]
    names = [f"b{j}" for j in range(features)]
    x = ready(rows).select(vector_to_array("features").alias("x"), "label")
    counted = x.select(*bins, "label").groupBy(*names).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
    held = VectorAssembler(inputCols=names, outputCol="features").transform(counted).select("features", "label", "w").persist()
    try:
        fitted = estimator.copy().setWeightCol("w").fit(held)
    finally:
        held.unpersist()
    tree, regression = spark._jvm.org.apache.spark.ml.tree, spark._jvm.org.apache.spark.ml.regression
    made = [regression.DecisionTreeRegressionModel(t.uid, _with_splits(t._java_obj.rootNode(), splits, tree), features)
            for t in (fitted.trees if isinstance(fitted, GBTRegressionModel) else [fitted])]
    if isinstance(fitted, DecisionTreeRegressionModel):
        out = DecisionTreeRegressionModel(made[0])
    else:
        kind = spark._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
        trees = spark.sparkContext._gateway.new_array(kind, len(made))
        weights = spark.sparkContext._gateway.new_array(spark._jvm.double, len(made))
        for i, (t, w) in enumerate(zip(made, fitted.treeWeights)):
            trees[i], weights[i] = t, float(w)
        out = GBTRegressionModel(regression.GBTRegressionModel(fitted.uid, trees, weights, features))
    out._resetUid(fitted.uid)
    return out
