"""Model explanations. Every method explodes modified copies of rows, scores them in one
distributed transform, and aggregates. All rows take part unless the caller asks for a sample."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import quoted
from tablewright.operators.evaluation import classification_metrics, regression_metrics
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.sampling import sample_n
from tablewright.plans.binned_trees import fit_binned
from tablewright.plans.models import CLASSIFICATION, TrainedModel, encode_target, spread
from tablewright.plans.tree_attribution import dependence, explain_rows, is_tree_model, tree_paths


#: rows of a group inside which permuted values change places
GROUP = 1000
#: groups, and places (rows times shuffles), of a block of rows that one task holds
BLOCK, BLOCK_PLACES = 64, 5_000_000


def feature_importance(model: TrainedModel, top: int = 15) -> DataFrame:
    """(feature, importance): tree importances, or absolute coefficients of a linear model."""
    inner = model.model
    if hasattr(inner, "featureImportances"):
        values = inner.featureImportances.toArray()
    elif hasattr(inner, "coefficientMatrix"):
        values = np.abs(inner.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(inner, "coefficients"):
        values = np.abs(inner.coefficients.toArray())
    elif hasattr(inner, "models"):
        values = np.mean([m.featureImportances.toArray() for m in inner.models], axis=0)
    else:
        raise ValueError(f"{type(inner).__name__} offers no importances")
    spark = SparkSession.active()
    rows = spark.createDataFrame([(f, float(v)) for f, v in zip(model.features, values)], "feature string, importance double")
    return rows.orderBy(F.col("importance").desc(), "feature").limit(top)


def _vectors(model: TrainedModel, df: DataFrame, key: str, n: int | None) -> DataFrame:
    """(id, label, x array): encoded features of all rows, or of n rows, which are persisted as every copy starts from them."""
    rows = df if n is None else sample_n(df, key, n)
    keep = [key] + ([model.target] if model.target in df.columns else [])
    ready = model.prepare(rows, keep)
    label = F.lit(None).cast("double")
    if model.target in df.columns:
        label = encode_target(ready, model.target, model.classes) if model.classes else quoted(model.target).cast("double")
    out = ready.select(quoted(key).alias("id"), label.alias("label"), vector_to_array("features").alias("x"))
    return out if n is None else out.persist()


def _output(model: TrainedModel, scored: DataFrame) -> Column:
    """The explained number: probability of the last class for a classifier, else the prediction."""
    if model.problem_type == CLASSIFICATION and "probability" in scored.columns:
        return vector_to_array("probability")[len(model.classes) - 1]
    return F.col("prediction")


def _score(model: TrainedModel, rows: DataFrame) -> DataFrame:
    """Adds ``f`` to rows with an ``x`` array."""
    scored = model.model.transform(rows.withColumn("features", array_to_vector("x")))
    return scored.select(*rows.columns, "prediction", _output(model, scored).alias("f"))


def _replaced(position: Column, value: Column) -> Column:
    return F.transform("x", lambda v, i: F.when(i == position, value).otherwise(v))


def _exchange(k: int, shuffles: int, most: int) -> Callable:
    """Copies (g, label, x) of a task's rows, which come in the order of their ids, for every shuffle g.

    In copy g feature g mod k comes from the row that has the same rank in the same group in the order of ``h``. Only a
    great many equal rows make a task hold more than ``most``; it then takes them in several parts.
    """
    schema = pa.schema([("g", pa.int32()), ("label", pa.float64()), ("x", pa.list_(pa.float64()))])

    def copies(rows: pa.Table):
        n = rows.num_rows
        label, x, b, h = (rows.column(c).combine_chunks() for c in ("label", "x", "b", "h"))
        x, b, h = (c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in (x, b, h))
        ends = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
        for g in range(shuffles):
            here, there = np.argsort(b[:, g], kind="stable"), np.lexsort((h[:, g], b[:, g]))
            moved = x.copy()
            moved[here, g % k] = x[there, g % k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, g, np.int32)), label, pa.ListArray.from_arrays(ends, pa.array(moved.ravel()))], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if n and n + batch.num_rows > most:
                yield from copies(pa.Table.from_batches(held))
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from copies(pa.Table.from_batches(held))

    return run


def permutation_importance(model: TrainedModel, df: DataFrame, key: str, repeats: int = 10, sample: int | None = None,
                           top: int = 15, seed: int = 42) -> DataFrame:
    """(feature, importance, std): loss of accuracy or R² when one feature is shuffled.

    Rows are dealt by hash into blocks of at most about ``BLOCK`` groups, in the only shuffle of rows. Inside a block they
    are dealt into groups of about ``GROUP`` rows, anew for every feature and repeat; inside a group row and donor are
    paired by their ranks in two orders. The copies are made where the block is, scored and added up without leaving
    the task, so what is shuffled does not grow with features and repeats.
    """
    base = _vectors(model, df, key, sample).where(F.col("label").isNotNull())
    k = len(model.features)
    n = base.count()
    groups = max(1, n // GROUP)
    blocks = max(1, -(-groups // BLOCK), n * k * repeats // BLOCK_PLACES)
    groups = max(1, groups // blocks)
    # label and x take part, so that a key that repeats does not gather its rows in one block
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id", "label", "x", F.lit(seed + 2)), F.lit(blocks)).cast("int"))
    held = dealt.repartitionById(blocks, "block").sortWithinPartitions("id", F.xxhash64("label", "x"))
    grid = F.sequence(F.lit(0), F.lit(k * repeats - 1))
    placed = held.select(
        "label", "x", F.transform(grid, lambda g: F.pmod(F.xxhash64("id", g, F.lit(seed + 1)), F.lit(groups))).alias("b"),
        F.transform(grid, lambda g: F.xxhash64("id", g, F.lit(seed))).alias("h"))
    exchange = _exchange(k, k * repeats, 2 * (n // blocks + GROUP))
    shuffled = placed.mapInArrow(exchange, "g int, label double, x array<double>").withColumn("j", (F.col("g") % k).cast("int"))
    scored = _score(model, shuffled.select("g", "j", "label", "x")).select("g", "j", F.col("label").alias("actual"), F.col("prediction").alias("pred"))
    plain = _score(model, base.select("label", "x")).select(F.col("label").alias("actual"), F.col("prediction").alias("pred"))
    if model.problem_type == CLASSIFICATION:
        worse = classification_metrics(scored, by=["g", "j"]).select("g", "j", F.col("accuracy").alias("s"))
        reference = classification_metrics(plain).select(F.col("accuracy").alias("s0"))
    else:
        worse = regression_metrics(scored, by=["g", "j"]).select("g", "j", F.col("r2_score").alias("s"))
        reference = regression_metrics(plain).select(F.col("r2_score").alias("s0"))
    names = F.array(*[F.lit(f) for f in model.features])
    drop = F.col("s0") - F.col("s")
    return (worse.crossJoin(F.broadcast(reference)).groupBy(F.get(names, F.col("j")).alias("feature"))
            .agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std"))
            .orderBy(F.col("importance").desc(), "feature").limit(top))


def partial_dependence(model: TrainedModel, df: DataFrame, key: str, features: list[str] | None = None,
                       points: int = 100, sample: int | None = None) -> DataFrame:
    """(feature, value, mean_prediction): mean output over the rows with one feature set to each grid value.

    The grid spans the 5 % to 95 % quantiles of the encoded feature; where fewer distinct
    values exist, those are the grid. Features default to the four most important ones. Trees and forests are
    read once (``dependence``); other models score every row with every value.
    """
    if features is None:
        features = [r["feature"] for r in feature_importance(model, 4).collect()]
    base = _vectors(model, df, key, sample)
    wide = base.select(*[F.get("x", F.lit(model.features.index(f))).alias(f) for f in features])
    ends = {r["column"]: r for r in exact_quantiles(wide, features, {"lo": 0.05, "hi": 0.95}).collect()}
    grids = {}
    for f in features:
        # no more than ``points`` values come back; as many mean that the grid is needed
        values = sorted(r[0] for r in wide.select(quoted(f)).distinct().limit(points).collect() if r[0] is not None)
        if len(values) >= points:
            values = np.linspace(ends[f]["lo"], ends[f]["hi"], points).tolist()
        grids[f] = [float(v) for v in values]
    if _adds_up(model) and all(np.isfinite(g).all() for g in grids.values()):
        paths = tree_paths(model.model, len(model.classes) if model.problem_type == CLASSIFICATION else 0)
        grids = {model.features.index(f): sorted(set(g)) for f, g in grids.items()}
        means = dependence(base, paths, grids) or {}
        rows = [(model.features[j], v, m) for j, found in means.items() for v, m in zip(grids[j], found)]
        return df.sparkSession.createDataFrame(rows, "feature string, value double, mean_prediction double")
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(model.features.index(f)).alias("j"), F.array(*[F.lit(v) for v in g]).alias("grid"))
             for f, g in grids.items()]
    copies = (base.select("x", F.inline(F.array(*cells))).select("x", "feature", "j", F.explode("grid").alias("value")))
    rows = copies.withColumn("x", _replaced(F.col("j"), F.col("value")))
    return _score(model, rows).groupBy("feature", "value").agg(F.avg("f").alias("mean_prediction"))


def _adds_up(model: TrainedModel) -> bool:
    """Whether the explained number is a sum over the paths of the model's trees: not the probability of boosting."""
    return is_tree_model(model.model) and not hasattr(model.model, "models") and (
        model.problem_type != CLASSIFICATION or not type(model.model).__name__.startswith("GBT"))


def tree_attribution(model: TrainedModel, df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """(id, feature, attribution, f, base): exact Shapley values of a tree model for all rows, or for as many as asked for.

    Absent features follow the training rows' shares. The explained number is the prediction or the last class's probability
    of a tree or forest, and the raw score of a boosted classifier, in which its trees add up.
    """
    paths = tree_paths(model.model, len(model.classes) if model.problem_type == CLASSIFICATION else 0)
    return explain_rows(_vectors(model, df, key, rows), paths, model.features)


def shapley_attribution(model: TrainedModel, df: DataFrame, key: str, rows: int = 10, background: int | None = None,
                        permutations: int = 10, seed: int = 42) -> DataFrame:
    """(id, feature, attribution, f, base): exact for tree models, else Monte-Carlo Shapley values by ``shapley_walks``."""
    if is_tree_model(model.model):
        return tree_attribution(model, df, key, rows)
    return shapley_walks(model, df, key, rows, background, permutations, seed)


def shapley_walks(model: TrainedModel, df: DataFrame, key: str, rows: int = 10, background: int | None = None,
                  permutations: int = 10, seed: int = 42) -> DataFrame:
    """(id, feature, attribution, f, base): Monte-Carlo Shapley values of any model by random feature orders.

    Each (row, background row, order) is a walk from the background row to the row; one step is
    one feature's share: what is scored after it counts for the feature, what is scored before it against it. Every
    order meets every background row (all rows, or as many as asked for), so the shares of a row add up to
    f(x) − mean f(background) exactly. The ``rows`` explained rows are broadcast, the background is scanned.
    """
    k = len(model.features)
    rng = random.Random(seed)
    orders = [rng.sample(range(k), k) for _ in range(permutations)]
    explained = _vectors(model, df, key, rows).select("id", "x")
    back = df if background is None else sample_n(df, key, background, seed + 1)
    pairs = _vectors(model, back, key, None).select(F.col("x").alias("z")).crossJoin(F.broadcast(explained))
    # what is scored depends on the set of features taken from the row only: each set once, however many walks pass it
    sets: dict[int, list[list[int]]] = {}
    for order in orders:
        for step in range(k + 1):
            at = sets.setdefault(sum(1 << j for j in order[:step]), [[0, 0] for _ in range(k)])
            if step:
                at[order[step - 1]][0] += 1
            if step < k:
                at[order[step]][1] += 1
    everything = (1 << k) - 1
    moves = F.array(*[F.struct(
        F.array(*[F.lit(bool(s >> j & 1)) for j in range(k)]).alias("taken"), F.lit(s == 0).alias("none"), F.lit(s == everything).alias("all"),
        F.array(*[F.struct(F.lit(j).alias("j"), F.lit(a).alias("after"), F.lit(b).alias("before")) for j, (a, b) in enumerate(at) if a or b])
        .alias("steps")) for s, at in sorted(sets.items())])
    mixed = F.transform("x", lambda v, i: F.when(F.get("taken", i), v).otherwise(F.get(F.col("z"), i)))
    steps = pairs.select("id", "x", "z", F.inline(moves)).select("id", "none", "all", "steps", mixed.alias("x"))
    scored = _score(model, steps)
    names = F.array(*[F.lit(f) for f in model.features])
    moved = scored.select("id", "f", F.inline("steps")).withColumn("feature", F.get(names, F.col("j")))
    share = F.sum((F.col("after") - F.col("before")) * F.col("f")) / F.sum("after")
    totals = scored.groupBy("id").agg(F.avg(F.when(F.col("all"), F.col("f"))).alias("f"),
                                      F.avg(F.when(F.col("none"), F.col("f"))).alias("base"))
    return (moved.groupBy("id", "feature").agg(share.alias("attribution"))
            .join(F.broadcast(totals), "id"))


def linear_attribution(model: TrainedModel, df: DataFrame, key: str) -> DataFrame:
    """(id, feature, attribution): the exact Shapley values of a linear model, weight × (x − mean of x over all rows)."""
    inner = model.model
    weights = (inner.coefficients if hasattr(inner, "coefficients") and model.problem_type != CLASSIFICATION
               else inner.coefficientMatrix.toArray()[-1])
    base = _vectors(model, df, key, None)
    at = [F.get("x", F.lit(j)) for j in range(len(model.features))]
    mean = base.agg(F.array(*[F.avg(x) for x in at]).alias("m"))  # one row
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (x - F.get("m", F.lit(j)))).alias("attribution"))
                      for j, (f, w, x) in enumerate(zip(model.features, weights, at))])
    return base.crossJoin(F.broadcast(mean)).select("id", F.inline(cells))


def top_attributions(attributions: DataFrame, k: int = 5) -> DataFrame:
    """The k largest signed attributions per row by absolute value."""
    order = W.partitionBy("id").orderBy(F.abs("attribution").desc(), "feature")  # one row per feature
    return attributions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _uniform(*parts: Column) -> Column:
    """A repeatable number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def lime_local(model: TrainedModel, df: DataFrame, key: str, rows: int = 3, features: int = 8, samples: int = 1000) -> DataFrame:
    """(id, feature, weight): local linear weights of a few rows from scored Gaussian perturbations.

    Perturbation noise comes from hashes, so it does not depend on partitioning. The weighted
    normal equations are summed by Spark; per row only a (k+1)×(k+1) system is solved.
    """
    k = len(model.features)
    explained = _vectors(model, df, key, rows).select("id", "x")
    spread = _vectors(model, df, key, None)
    sd = spread.agg(F.array(*[F.coalesce(F.stddev_pop(F.get("x", F.lit(j))), F.lit(0.0)) for j in range(k)]).alias("sd"))
    draws = (explained.crossJoin(F.broadcast(sd))  # one row
             .select("id", "x", "sd", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("s")))
    normal = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.sqrt(-2 * F.ln(_uniform(F.col("id"), F.col("s"), j, F.lit(1))))
                         * F.cos(6.283185307179586 * _uniform(F.col("id"), F.col("s"), j, F.lit(2))))
    moved = draws.withColumn("e", normal).withColumn("x", F.zip_with(
        "x", F.zip_with("e", "sd", lambda e, d: e * d), lambda a, b: a + b))
    distance = F.aggregate("e", F.lit(0.0), lambda acc, e: acc + e * e)
    kernel = F.exp(-distance / (0.75 * 0.75 * k))
    scored = _score(model, moved.select("id", "e", kernel.alias("w"), "x"))
    a = F.concat(F.array(F.lit(1.0)), F.col("e"))
    sums = [F.sum(F.col("w") * F.get("a", F.lit(i)) * F.get("a", F.lit(j))).alias(f"m{i}_{j}") for i in range(k + 1) for j in range(k + 1)]
    rhs = [F.sum(F.col("w") * F.get("a", F.lit(i)) * F.col("f")).alias(f"v{i}") for i in range(k + 1)]
    equations = scored.withColumn("a", a).groupBy("id").agg(*sums, *rhs)
    names = list(model.features)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = np.array([[row[f"m{i}_{j}"] for j in range(k + 1)] for i in range(k + 1)])
                v = np.array([row[f"v{i}"] for i in range(k + 1)])
                beta = np.linalg.solve(m + 1e-6 * np.eye(k + 1), v)[1:]
                best = np.argsort(-np.abs(beta))[:features]
                out += [(row["id"], names[j], float(beta[j])) for j in best]
            yield pd.DataFrame(out, columns=["id", "feature", "weight"])

    id_type = equations.schema["id"].dataType.simpleString()
    return equations.mapInPandas(solve, f"id {id_type}, feature string, weight double")


def surrogate_tree(model: TrainedModel, df: DataFrame, key: str, depth: int = 4):
    """(tree model, fidelity frame): a small tree fitted to the model's own predictions on all rows."""
    def scores(rows: DataFrame) -> DataFrame:
        return model.score(rows).select("features", F.col("prediction").alias("label"))

    present = [quoted(f) for f in model.features if f in df.columns]
    if model.problem_type == CLASSIFICATION:
        fitted = DecisionTreeClassifier(maxDepth=depth, seed=42).fit(scores(spread(df.select(*present), len(model.features))))
    else:
        fitted = fit_binned(DecisionTreeRegressor(maxDepth=depth, seed=42), df.select(*present), scores, len(model.features))
    scored = scores(df)
    both = fitted.transform(scored).select(F.col("label").alias("actual"), F.col("prediction").alias("pred"))
    if model.problem_type == CLASSIFICATION:
        return fitted, classification_metrics(both).select(F.col("accuracy").alias("fidelity"))
    return fitted, regression_metrics(both).select(F.col("r2_score").alias("fidelity"))


def tree_rules(tree, features: list[str], spark) -> DataFrame:
    """(line, indent, rule): the printed tree with feature names; at most 2^depth leaves."""
    rows = []
    for line in tree.toDebugString.splitlines()[1:]:
        text = line.strip()
        for i in range(len(features) - 1, -1, -1):
            text = text.replace(f"feature {i} ", f"{features[i]} ")
        rows.append((len(rows), len(line) - len(line.lstrip()), text))
    return spark.createDataFrame(rows, "line int, indent int, rule string")
