"""Exact Shapley values of tree models, one pass over the rows.

A feature that is absent from a subset sends a row down both children of its splits, in proportion to the training rows that
went there. Under that rule a tree is a sum over its leaves: a leaf's path asks each of its features for a range (or a set of
categories); a present feature passes or not (o is 1 or 0), an absent one passes with the product z of its shares. The
Shapley value of a feature is the leaf's value times (o - z) times the sum, over the subsets of the path's other features, of
the subset's weight and the product of o of its members and z of the rest. That sum is the coefficient vector of a product of
linear factors, weighted by subset size, so a path of D features costs D squared steps instead of 2^D.

The paths (leaves times depth) travel to the tasks in one broadcast variable; rows are scored where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.tables import scratch_dir

#: most rows whose patterns are worked on at once
ROWS = 8192
#: most features of a path for which the values of all patterns are worked out beforehand
BITS = 8


@dataclass
class Path:
    """From the root to a leaf: per feature on it what lets a row pass, and the share of training rows that do."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    allowed: dict[int, frozenset]  # by position on the path, for splits by category
    shares: np.ndarray
    value: float

    def passes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.passes_one(k, x[:, f]) for k, f in enumerate(self.features)])

    def passes_one(self, k: int, at: np.ndarray) -> np.ndarray:
        """Which values of the feature at position k of the path it lets pass."""
        if k in self.allowed:
            return np.isin(at, list(self.allowed[k]))
        return (at > self.low[k]) & (at <= self.high[k])

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """The features that let each row pass, as the bits of a number; ``columns`` is (feature, row)."""
        out = np.zeros(columns.shape[1], np.int64)
        for k, f in enumerate(self.features):
            out |= self.passes_one(k, columns[f]).astype(np.int64) << k
        return out


def _paths(nodes: dict, classes: int, weight: float) -> list[Path]:
    def leaf_value(node) -> float:
        if not classes:
            return weight * node["prediction"]
        total = sum(node["impurityStats"])
        return weight * (node["impurityStats"][classes - 1] / total if total else 0.0)

    found, stack = [], [(0, {})]
    while stack:
        number, seen = stack.pop()
        node = nodes[number]
        if node["leftChild"] < 0:
            order = sorted(seen)
            found.append(Path(np.array(order, np.int64), np.array([seen[f][0] for f in order]), np.array([seen[f][1] for f in order]),
                              {k: seen[f][2] for k, f in enumerate(order) if seen[f][2] is not None},
                              np.array([seen[f][3] for f in order]), leaf_value(node)))
            continue
        split, feature = node["split"], node["split"]["featureIndex"]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            low, high, kept, share = seen.get(feature, (-np.inf, np.inf, None, 1.0))
            values = split["leftCategoriesOrThreshold"]
            if split["numCategories"] < 0:
                low, high = (low, min(high, values[0])) if left else (max(low, values[0]), high)
            else:
                here = frozenset(values) if left else frozenset(float(c) for c in range(split["numCategories"])) - frozenset(values)
                kept = here if kept is None else kept & here
            share *= nodes[child]["rawCount"] / node["rawCount"]
            stack.append((child, {**seen, feature: (low, high, kept, share)}))
    return found


def is_tree_model(model: Model) -> bool:
    inner = model.models[-1] if hasattr(model, "models") else model
    return hasattr(inner, "trees") or hasattr(inner, "depth")


def tree_paths(model: Model, classes: int = 0) -> list[Path]:
    """All paths of a tree, forest or boosted model, read from its saved form. The values of its leaves on a row's paths add up
    to the forest's mean prediction (probability of the last of ``classes``), or to the raw score of boosting. Of a one-vs-rest
    model it is the last class's."""
    inner = model.models[-1] if hasattr(model, "models") else model
    spark = SparkSession.active()
    folder = scratch_dir(spark, "trees")
    inner.write().overwrite().save(f"{folder}/model")
    stored = spark.read.parquet(f"{folder}/model/data")
    single = "treeID" not in stored.columns
    rows = stored.select(F.lit(0).alias("treeID"), F.struct(*stored.columns).alias("nodeData")) if single else stored
    trees: dict[int, dict] = {}
    for r in rows.toLocalIterator():  # the model itself, which the driver holds already
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    boosted = type(inner).__name__.startswith("GBT")
    weights = list(inner.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    return [p for i, nodes in sorted(trees.items()) for p in _paths(nodes, 0 if boosted else classes, weights[i])]


def path_attributions(path: Path, inside: np.ndarray) -> np.ndarray:
    """(row, feature on the path): Shapley values of one leaf, from which features let the row pass."""
    rows, d = inside.shape
    o, z = inside.astype(float), path.shares
    # [row, k, m]: over the features other than k, the sum of products in which m of them are present
    sums = np.zeros((rows, d, d))
    sums[:, :, 0] = 1.0
    for j in range(d):
        grown = sums * z[j]
        grown[:, :, 1:] += sums[:, :, :-1] * o[:, j, None, None]
        grown[:, j] = sums[:, j]
        sums = grown
    weights = np.array([factorial(m) * factorial(d - m - 1) / factorial(d) for m in range(d)])
    return path.value * (o - z) * (sums @ weights)


def attributions(paths: list[Path], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(row, feature) Shapley values, the explained number of each row, and its mean over the training rows of the paths."""
    columns = np.ascontiguousarray(x.T)
    out, f, base = np.zeros(columns.shape), np.zeros(len(x)), 0.0
    for path in paths:
        base += path.value * path.shares.prod()
        if not len(path.features):
            f += path.value
            continue
        # rows that pass the same features share their values; there are at most 2^D kinds of them
        d = len(path.features)
        which = path.codes(columns)
        f += path.value * (which == (1 << d) - 1)
        if d > BITS:
            kinds, which = np.unique(which, return_inverse=True)
        else:
            kinds = np.arange(1 << d)
        values = path_attributions(path, (kinds[:, None] >> np.arange(d)) & 1 > 0)
        for k, feature in enumerate(path.features):
            out[feature] += values[:, k][which]
    return out.T, f, base


def dependence(vectors: DataFrame, paths: list[Path], grids: dict[int, list[float]]) -> dict[int, list[float]] | None:
    """The mean over all rows of the sum of the paths' leaves, with one feature (a position) set to each value of its grid.

    A leaf is reached under a set value if the value passes and the row passes the path's other features. So one scan
    counts, for every path, the rows that pass it whole and those that only the feature in question stops; the values of
    the grid cost nothing more. The counts are of the size of the model. None where there is no row.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(paths)

    def run(batches):
        paths = shared.value
        counts, n = [np.zeros(1 + len(p.features), np.int64) for p in paths], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n += part.num_rows
                columns = np.ascontiguousarray(
                    part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).T)
                for path, found in zip(paths, counts):
                    which, whole = path.codes(columns), (1 << len(path.features)) - 1
                    found[0] += np.count_nonzero(which == whole)
                    for k in range(len(path.features)):
                        found[k + 1] += np.count_nonzero(which == whole ^ (1 << k))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate(counts).tolist()], pa.list_(pa.int64()))], ["n", "counts"])

    parts = vectors.select("x").mapInArrow(run, "n bigint, counts array<bigint>")
    total = parts.agg(F.sum("n")).first()[0] if not paths else None
    cells = parts.select("n", F.posexplode("counts").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    total = cells[0]["n"] if cells else total
    if not total:
        return None
    flat, at = {r["i"]: r["c"] for r in cells}, 0
    out = {j: np.zeros(len(g)) for j, g in grids.items()}
    for path in paths:
        for j, grid in grids.items():
            where = np.flatnonzero(path.features == j)
            if len(where):
                k = int(where[0])
                out[j] += path.value * path.passes_one(k, np.array(grid)) * ((flat[at] + flat[at + k + 1]) / total)
            else:
                out[j] += path.value * (flat[at] / total)
        at += 1 + len(path.features)
    return {j: v.tolist() for j, v in out.items()}


def explain_rows(vectors: DataFrame, paths: list[Path], features: list[str]) -> DataFrame:
    """(id, feature, attribution, f, base) of every row of (id, x array); attributions of a row add up to f - base."""
    shared = vectors.sparkSession.sparkContext.broadcast(paths)
    kind = vectors.schema["id"].dataType.simpleString()
    k = len(features)

    def run(batches):
        paths = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = part.num_rows
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, k)
                values, f, base = attributions(paths, x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(f), pa.array(np.full(n, base))],
                                                 ["id", "values", "f", "base"])

    # a row leaves Python once and is taken apart by Spark
    rows = vectors.select("id", "x").mapInArrow(run, f"id {kind}, values array<double>, f double, base double")
    names = F.array(*[F.lit(f) for f in features])
    return rows.select("id", F.posexplode("values").alias("j", "attribution"), "f", "base").select(
        "id", F.get(names, F.col("j")).alias("feature"), "attribution", "f", "base")
