"""Model plans: bands, additivity, schema alignment, deterministic checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from tablewright.plans import explain, models

FEATURES = ["a", "b", "noise", "kind"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 600
    a, b, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    kind = rng.choice(["u", "v"], n)
    y = 3 * a - 2 * b + np.where(kind == "u", 1.0, 0.0)
    pdf = pd.DataFrame({"id": range(n), "a": a, "b": b, "noise": noise, "kind": kind, "y": y, "label": np.where(y > 0, "yes", "no")})
    return spark.createDataFrame(pdf).repartition(4).persist()


@pytest.fixture(scope="module")
def linear(data):
    return models.train(data, "y", "regression", "linear", FEATURES)


def test_training_recovers_the_rule(data, rows_by):
    _, metrics = models.training_pipeline(data.drop("label"), "id", "y", "regression", "linear")
    assert metrics.first()["r2_score"] > 0.999
    for algorithm in ("logistic", "random_forest", "gradient_boosting"):
        _, metrics = models.training_pipeline(data.drop("y"), "id", "label", "classification", algorithm, params={"n_estimators": 10, "max_depth": 4})
        assert metrics.first()["accuracy"] > 0.85
    with pytest.raises(ValueError):
        models.training_pipeline(data, "id", "nope", "regression", "linear")


def test_prediction_survives_a_different_schema(linear, data, spark):
    odd = data.select("id", "kind", "b", F.lit(1).alias("extra"), "a").limit(5)
    got = models.batch_inference(linear, odd, ["id"])
    assert got.count() == 5 and got.where("prediction IS NULL").count() == 0
    unseen = spark.createDataFrame([(0.0, 0.0, 0.0, "never")], "a double, b double, noise double, kind string")
    assert models.batch_inference(linear, unseen).first()["label"].count(".") == 1


def test_labels_and_probabilities(data):
    m = models.train(data, "label", "classification", "logistic", FEATURES)
    row = models.batch_inference(m, data, ["id"]).first()
    assert row["label"] in ("yes", "no") and math.isclose(sum(row["probabilities"].values()), 1.0)
    assert math.isclose(row["confidence"], row["probabilities"][row["label"]])


def test_dedupe_gives_the_same_predictions(linear, data):
    twice = data.unionByName(data)
    plain = {(r["id"], r["label"]) for r in models.batch_inference(linear, twice, ["id"]).collect()}
    deduped = models.batch_inference(linear, twice, ["id"], dedupe=True)
    assert deduped.count() == 1200 and {(r["id"], r["label"]) for r in deduped.collect()} == plain


def test_importances(linear, data, rows_by):
    order = [r["feature"] for r in explain.feature_importance(linear).collect()]
    assert order[:2] == ["a", "b"]
    got = rows_by(explain.permutation_importance(linear, data, "id", repeats=4, sample=300), "feature")
    assert got["a"]["importance"] > got["b"]["importance"] > got["kind"]["importance"] > 0.001
    assert abs(got["noise"]["importance"]) < 1e-3


def test_attributions_add_up(linear, data):
    got = explain.shapley_attribution(linear, data, "id", rows=4, background=6, permutations=5).toPandas()
    for _, part in got.groupby("id"):
        assert math.isclose(part["attribution"].sum(), part["f"].iloc[0] - part["base"].iloc[0], abs_tol=1e-9)
    # a linear model has a closed form: coefficient × (x − mean of background), so noise gets nothing
    assert got[got.feature == "noise"]["attribution"].abs().max() < 1e-2
    assert explain.top_attributions(explain.shapley_attribution(linear, data, "id", 2, 4, 2), 2).count() == 4


def test_linear_attribution_is_the_limit_of_the_walks(linear, data):
    exact = {(r["id"], r["feature"]): r["attribution"] for r in explain.linear_attribution(linear, data, "id").collect()}
    assert len(exact) == 600 * 4
    walks = explain.shapley_attribution(linear, data, "id", rows=3, permutations=2).collect()  # all rows as background
    assert len(walks) == 12 and all(math.isclose(r["attribution"], exact[(r["id"], r["feature"])], abs_tol=1e-6) for r in walks)


def test_permutation_in_small_groups(linear, data, rows_by, monkeypatch):
    monkeypatch.setattr(explain, "GROUP", 50)
    got = rows_by(explain.permutation_importance(linear, data, "id", repeats=3), "feature")
    assert got["a"]["importance"] > got["b"]["importance"] > got["kind"]["importance"] > 0.001 > abs(got["noise"]["importance"])


def test_partial_dependence_is_a_line(linear, data):
    got = explain.partial_dependence(linear, data, "id", ["a"], points=9, sample=100).orderBy("value").collect()
    steps = np.diff([r["mean_prediction"] for r in got]) / np.diff([r["value"] for r in got])
    assert len(got) == 9 and np.allclose(steps, steps[0]) and steps[0] > 0


def test_local_weights(linear, data):
    got = explain.lime_local(linear, data, "id", rows=2, samples=300).toPandas()
    w = got.pivot(index="id", columns="feature", values="weight")
    assert (w["a"] > 2.5).all() and (w["b"] < -1.5).all() and (w["noise"].abs() < 0.05).all()


def test_surrogate(data, spark):
    m = models.train(data, "label", "classification", "random_forest", FEATURES, {"n_estimators": 5, "max_depth": 3})
    tree, fidelity = explain.surrogate_tree(m, data, "id")
    assert fidelity.first()["fidelity"] > 0.85
    assert "a" in " ".join(r["rule"] for r in explain.tree_rules(tree, m.features, spark).collect())


def test_boosting_over_counted_bins_gives_the_trees_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 4000
    a, b, c = rng.normal(size=n), rng.integers(0, 9, n).astype(float), rng.exponential(size=n)
    pdf = pd.DataFrame({"id": range(n), "a": a, "b": b, "c": c, "y": 3 * a + 2 * np.sin(2 * b) + a * c + rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    fitted, fit = [], GBTRegressor._fit

    def counting(self, rows):
        fitted.append(rows.count())
        return fit(self, rows)

    monkeypatch.setattr(GBTRegressor, "_fit", counting)
    names, params = ["a", "b", "c"], {"n_estimators": 5, "max_depth": 3}
    m = models.train(df, "y", "regression", "gradient_boosting", names, params)
    ready = m.prepare(df, ["y"]).withColumnRenamed("y", "label")
    plain = fit(models.ALGORITHMS["regression", "gradient_boosting"](params), ready)
    both = np.array([(x.prediction, plain.predict(x.features)) for x in m.model.transform(ready).limit(500).collect()])
    assert np.allclose(both[:, 0], both[:, 1]) and np.allclose(m.model.featureImportances.toArray(), plain.featureImportances.toArray())
    # the solver's passes go over combinations of bins, whose number does not grow with the rows
    again = models.train(df.unionByName(df).unionByName(df.withColumn("a", F.col("a") + 1e-9)), "y", "regression", "gradient_boosting", names, params)
    assert fitted[0] < n and fitted[1] < 1.2 * n and again.model.getNumTrees == 5
    tree, fidelity = explain.surrogate_tree(m, df, "id")
    scored = m.score(df).select("features", F.col("prediction").alias("label"))
    direct = DecisionTreeRegressor(maxDepth=4, seed=42).fit(scored)
    assert all(math.isclose(tree.predict(x.features), direct.predict(x.features)) for x in scored.limit(300).collect())
    assert fidelity.first()["fidelity"] > 0.5 and tree.depth == 4


def test_learning_curve(data):
    got = models.learning_curve(data.drop("y"), "id", "label", "classification", "logistic", [0.1, 1.0]).collect()
    assert len(got) == 4 and all(0.5 < r["score"] <= 1 for r in got)


def test_release_checks(spark):
    good = spark.createDataFrame([(i % 2, i % 2) for i in range(200)], "actual int, pred int")
    got = {r["check"]: r["status"] for r in models.model_validation(good.withColumn("again", F.col("pred").cast("double")), second="again").collect()}
    assert got == {"performance_check": "PASSED", "prediction_distribution_check": "PASSED", "reproducibility_check": "PASSED", "feature_importance_check": "SKIPPED"}
    flat = spark.createDataFrame([(i % 2, 1) for i in range(200)], "actual int, pred int")
    lopsided = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "feature string, importance double")
    checks = models.model_validation(flat, importances=lopsided)
    got = {r["check"]: r["status"] for r in checks.collect()}
    assert got["performance_check"] == "FAILED" and got["prediction_distribution_check"] == "WARNING" and got["feature_importance_check"] == "WARNING"
    assert models.overall_status(checks).first()[0] == "FAILED"


def brute_force(paths, x, k):
    """Shapley values by all subsets: a present feature decides its splits, an absent one counts by the shares."""
    from itertools import combinations

    def value(subset):
        total = 0.0
        for p in paths:
            inside = p.passes(x[None, :])[0]
            total += p.value * np.prod([inside[i] if f in subset else p.shares[i] for i, f in enumerate(p.features)])
        return total

    out = np.zeros(k)
    for f in range(k):
        rest = [g for g in range(k) if g != f]
        for m in range(k):
            for some in combinations(rest, m):
                weight = math.factorial(m) * math.factorial(k - m - 1) / math.factorial(k)
                out[f] += weight * (value({*some, f}) - value(set(some)))
    return out, value(set())


@pytest.mark.parametrize("problem,algorithm", [("regression", "random_forest"), ("regression", "gradient_boosting"),
                                               ("classification", "random_forest"), ("classification", "gradient_boosting")])
def test_tree_attribution_equals_all_subsets(spark, problem, algorithm):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 6))
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0, 2.0, 0.0) * x[:, 3] + 0.1 * x[:, 4]
    pdf = pd.DataFrame(x, columns=list("abcdef")).assign(id=range(400), y=y if problem == "regression" else np.where(y > 0, "up", "down"))
    df = spark.createDataFrame(pdf).repartition(3)
    m = models.train(df.drop("id"), "y", problem, algorithm, params={"n_estimators": 4, "max_depth": 5})
    got = explain.tree_attribution(m, df, "id").collect()
    assert len(got) == 400 * 6
    by_row = {}
    for r in got:
        by_row.setdefault(r["id"], {})[r["feature"]] = r
    paths = explain.tree_paths(m.model, 2 if problem == "classification" else 0)
    vectors = {r["id"]: np.array(r["x"]) for r in explain._vectors(m, df, "id", None).collect()}
    for i in range(0, 400, 50):
        want, base = brute_force(paths, vectors[i], 6)
        assert np.allclose([by_row[i][f]["attribution"] for f in m.features], want, atol=1e-10)
        assert math.isclose(by_row[i]["a"]["base"], base, abs_tol=1e-10)
    scored = {r["id"]: r for r in m.score(df, ["id"]).collect()}
    for i, some in by_row.items():
        f = some["a"]["f"]
        assert math.isclose(sum(r["attribution"] for r in some.values()), f - some["a"]["base"], abs_tol=1e-9)
        if problem == "regression":
            assert math.isclose(f, scored[i]["prediction"], abs_tol=1e-9)
        else:
            p = scored[i]["probability"][1]
            assert math.isclose(f if algorithm == "random_forest" else 1 / (1 + math.exp(-2 * f)), p, abs_tol=1e-9)


def test_paths_by_category_and_single_leaves():
    from tablewright.plans.tree_attribution import _paths, attributions
    split = {"featureIndex": 1, "leftCategoriesOrThreshold": [0.0, 2.0], "numCategories": 3}
    leaf = {"leftChild": -1, "rightChild": -1, "split": None}
    nodes = {0: {"leftChild": 1, "rightChild": 2, "rawCount": 10, "split": split},
             1: {**leaf, "rawCount": 6, "prediction": 5.0}, 2: {**leaf, "rawCount": 4, "prediction": 1.0}}
    values, f, base = attributions(_paths(nodes, 0, 1.0), np.array([[9.0, 2.0], [9.0, 1.0]]))
    assert f.tolist() == [5.0, 1.0] and math.isclose(base, 3.4) and np.allclose(values, [[0, 1.6], [0, -2.4]])
    only = _paths({0: {**leaf, "rawCount": 3, "prediction": 7.0}}, 0, 0.5)
    values, f, base = attributions(only, np.zeros((2, 2)))
    assert f.tolist() == [3.5, 3.5] and base == 3.5 and not values.any()


def test_encoding_leaves_rows_where_they_are(spark):
    from tablewright.operators import cleaning
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(0, 8000, 1, 8).select("id", F.when(F.col("id") % 10 < 8, "often").otherwise("rare").alias("c"))
        parts = cleaning.label_encode(df, "c").groupBy(F.spark_partition_id().alias("p"), "c").count().groupBy("p").agg(F.sum("count").alias("n"))
        assert sorted(r["n"] for r in parts.collect()) == [1000] * 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_training_rows_are_spread(spark, monkeypatch):
    df = spark.range(0, 4000, 1, 2).select("id", (F.col("id") % 7).alias("a"))
    assert models.spread(df, 2).rdd.getNumPartitions() == 2
    monkeypatch.setattr(models, "CELLS", 200)
    wide = models.spread(df, 2)
    sizes = [r["count"] for r in wide.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 200 and sum(sizes) == 4000


@pytest.mark.parametrize("target,problem", [("y", "regression"), ("label", "classification")])
def test_partial_dependence_of_a_forest_scores_no_copies(data, monkeypatch, target, problem):
    m = models.train(data, target, problem, "random_forest", FEATURES, {"n_estimators": 3, "max_depth": 4})
    with monkeypatch.context() as patch:
        patch.setattr(explain, "_adds_up", lambda model: False)
        want = {(r["feature"], r["value"]): r["mean_prediction"] for r in explain.partial_dependence(m, data, "id", ["a", "kind"], points=7).collect()}
    monkeypatch.setattr(explain, "_score", None)
    got = {(r["feature"], r["value"]): r["mean_prediction"] for r in explain.partial_dependence(m, data, "id", ["a", "kind"], points=7).collect()}
    assert got.keys() == want.keys() and len(got) == 9 and all(math.isclose(v, want[c], abs_tol=1e-9) for c, v in got.items())


def test_walks_score_each_set_once(linear, data, monkeypatch):
    scored, score = [], explain._score
    monkeypatch.setattr(explain, "_score", lambda model, rows: scored.append(rows.count()) or score(model, rows))
    explain.shapley_walks(linear, data, "id", rows=1, background=5, permutations=20)
    assert max(scored) <= 5 * 2 ** 4


def test_permutation_shuffles_rows_once(linear, data, monkeypatch, capsys):
    monkeypatch.setattr(explain, "GROUP", 50)
    monkeypatch.setattr(explain, "BLOCK", 3)
    moved, score = [], explain._score
    monkeypatch.setattr(explain, "_score", lambda model, rows: moved.append(rows) or score(model, rows))
    twice = data.unionByName(data.withColumn("y", F.col("y") + 1))  # each key comes twice
    explain.permutation_importance(linear, twice, "id", repeats=2).explain()
    plan = capsys.readouterr().out
    # copies are neither ranked by windows nor joined: they are made above the shuffle of rows
    assert "row_number" not in plan and "MapInArrow" in plan
    plain = explain._vectors(linear, twice, "id", None).toPandas()
    got = moved[0].toPandas()
    assert len(got) == 8 * 1200
    for g, part in got.groupby("g"):
        x, was = np.array(part["x"].tolist()), np.array(plain["x"].tolist())
        rest = [i for i in range(4) if i != g % 4]
        assert sorted(x[:, g % 4]) == sorted(was[:, g % 4])
        assert sorted(map(tuple, np.c_[x[:, rest], part["label"]])) == sorted(map(tuple, np.c_[was[:, rest], plain["label"]]))
        if g % 4 < 3:
            known = {tuple(v) for v in np.c_[was, plain["label"]]}
            assert np.mean([tuple(v) in known for v in np.c_[x, part["label"]]]) < 0.1


def test_permutation_pairs_by_ranks(linear, data, monkeypatch):
    monkeypatch.setattr(explain, "GROUP", 50)
    moved, score = [], explain._score
    monkeypatch.setattr(explain, "_score", lambda model, rows: moved.append(rows) or score(model, rows))
    explain.permutation_importance(linear, data, "id", repeats=2, seed=5)
    g = F.explode(F.sequence(F.lit(0), F.lit(7)))
    ranked = explain._vectors(linear, data, "id", None).select("id", "x", g.alias("g")).select(
        "*", F.pmod(F.xxhash64("id", "g", F.lit(6)), F.lit(12)).alias("b"), F.xxhash64("id", "g", F.lit(5)).alias("h")).toPandas()
    want = set()
    for (g, _), part in ranked.groupby(["g", "b"]):
        x = np.array(part.sort_values("id")["x"].tolist())
        x[:, g % 4] = np.array(part.sort_values("h")["x"].tolist())[:, g % 4]
        want |= {(g, *v) for v in x}
    assert {(r["g"], *r["x"]) for r in moved[0].collect()} == want


def test_training_rows_leave_a_full_partition(spark, monkeypatch):
    monkeypatch.setattr(models, "CELLS", 2000)
    one = spark.range(0, 4000, 1, 1).select("id", (F.col("id") % 7).alias("a"))  # fewer shares than cores
    sizes = [r["count"] for r in models.spread(one, 2).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 4000
