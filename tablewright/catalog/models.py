"""Training, scoring, validation and explanation on documents with labels and on lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded
from tablewright.catalog.tables import SCORED_MULTI
from tablewright.plans import explain, models

SMALL = {"n_estimators": 10, "max_depth": 4}


def binary(t):
    d = t.documents.select("doc_id", "n_chars", "lang", "source")
    return t.labels.select("doc_id", "quality").join(d, "doc_id")


def prices(t):
    """lineitem with a row key, as (orderkey, linenumber) is not unique."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string"))
    return t.lineitem.select(key.alias("row_id"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")


def classifier(t, algorithm="random_forest"):
    return models.train(binary(t).drop("doc_id"), "quality", "classification", algorithm, params=SMALL)


def regressor(t, algorithm="random_forest"):
    return models.train(prices(t).drop("row_id"), "l_extendedprice", "regression", algorithm, params=SMALL)


for _kind, _algorithm, _row in (("classification", "logistic", "M1"), ("classification", "random_forest", "M2"),
                                ("classification", "gradient_boosting", "M3"), ("regression", "linear", "M1"),
                                ("regression", "random_forest", "M2"), ("regression", "gradient_boosting", "M3")):
    def _trained(t, kind=_kind, algorithm=_algorithm):
        if kind == "classification":
            _, metrics = models.training_pipeline(binary(t), "doc_id", "quality", kind, algorithm, params=SMALL)
        else:
            _, metrics = models.training_pipeline(prices(t), "row_id", "l_extendedprice", kind, algorithm, params=SMALL)
        return rounded(metrics)
    query(f"train_{_kind}_{_algorithm}", f"{_row} M4 M5")(_trained)


@query("train_multiclass_boosting", "M3 M4")
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    _, metrics = models.training_pipeline(df, "o_orderkey", "o_orderstatus", "classification", "gradient_boosting",
                                          params={"n_estimators": 3, "max_depth": 3})
    return rounded(metrics)


@query("linear_regression_line", "M1", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem""")
def _(t):
    # standardised feature: slope and intercept are scaled back with the fitted mean and deviation
    m = models.train(t.lineitem.select("l_quantity", "l_extendedprice"), "l_extendedprice", "regression", "linear")
    s = m.preprocessor.scaler["l_quantity"]
    slope = float(m.model.coefficients[0]) / s["std"]
    line = t.spark.createDataFrame([(slope, float(m.model.intercept) - slope * s["mean"])], "slope double, intercept double")
    return rounded(line, 3, intercept=1)


@query("batch_inference", "M6 M7 M8 U5")
def _(t):
    out = models.batch_inference(classifier(t), binary(t), ["doc_id"])
    return out.withColumn("probabilities", F.to_json("probabilities"))


@query("batch_inference_deduplicated", "M6 H21")
def _(t):
    return models.batch_inference(regressor(t, "linear"), prices(t), ["row_id"], dedupe=True)


@query("model_validation", "M9 U4", f"""
SELECT 'performance_check' AS "check", CASE WHEN count(*) < 100 THEN 'WARNING' WHEN avg((actual = pred)::INT) >= 0.8 THEN 'PASSED' ELSE 'FAILED' END AS status,
  round(avg((actual = pred)::INT), 6) AS value FROM {SCORED_MULTI}
UNION ALL SELECT 'prediction_distribution_check', 'PASSED', NULL UNION ALL SELECT 'reproducibility_check', 'SKIPPED', NULL
UNION ALL SELECT 'feature_importance_check', 'SKIPPED', NULL""")
def _(t):
    return rounded(models.model_validation(t.scored_multi))


@query("model_validation_overall", "M9")
def _(t):
    m = classifier(t)
    scored = models.scored_table(m, binary(t), "doc_id")
    return models.overall_status(models.model_validation(scored, importances=explain.feature_importance(m)))


@query("run_checks", "U4", """
SELECT 'enough_rows' AS "check", count(*) > 100 AS passed FROM orders UNION ALL SELECT 'positive_prices', min(o_totalprice) > 0 FROM orders
UNION ALL SELECT 'one_status', count(DISTINCT o_orderstatus) = 1 FROM orders""")
def _(t):
    return models.run_checks(t.orders, {
        "enough_rows": F.count(F.lit(1)) > 100, "positive_prices": F.min("o_totalprice") > 0,
        "one_status": F.min("o_orderstatus") == F.max("o_orderstatus")})


@query("feature_importance", "N1")
def _(t):
    return explain.feature_importance(regressor(t))


@query("permutation_importance", "N2")
def _(t):
    return explain.permutation_importance(regressor(t, "linear"), prices(t), "row_id")


@query("partial_dependence", "N3")
def _(t):
    return explain.partial_dependence(regressor(t), prices(t), "row_id")


@query("shapley_attribution", "N4")
def _(t):
    return explain.top_attributions(explain.shapley_attribution(classifier(t), binary(t), "doc_id"))


@query("tree_attribution", "N4")
def _(t):
    return rounded(explain.tree_attribution(regressor(t), prices(t), "row_id").groupBy("feature").agg(
        F.avg(F.abs("attribution")).alias("mean_attribution"), F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("f"))).alias("largest")))


@query("shapley_walks", "N4")
def _(t):
    return explain.top_attributions(explain.shapley_walks(classifier(t), binary(t), "doc_id"))


@query("linear_attribution", "N4", """
WITH m AS (SELECT avg(l_quantity) AS q, regr_slope(l_extendedprice, l_quantity) AS s FROM lineitem)
SELECT l_quantity AS id, 'l_quantity' AS feature, count(*) AS n, round(any_value(s) * (l_quantity - any_value(q)), 2) AS attribution
FROM lineitem, m GROUP BY l_quantity""")
def _(t):
    df = t.lineitem.select("l_quantity", "l_extendedprice")
    m = models.train(df, "l_extendedprice", "regression", "linear")
    return rounded(explain.linear_attribution(m, df, "l_quantity").groupBy("id", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("attribution").alias("attribution")), 2)


@query("lime_local", "N5")
def _(t):
    return explain.lime_local(regressor(t), prices(t), "row_id")


@query("surrogate_tree", "N6")
def _(t):
    tree, fidelity = explain.surrogate_tree(regressor(t, "gradient_boosting"), prices(t), "row_id")
    return rounded(fidelity)


@query("surrogate_tree_rules", "N6")
def _(t):
    m = classifier(t)
    tree, _ = explain.surrogate_tree(m, binary(t), "doc_id")
    return explain.tree_rules(tree, m.features, t.spark)


@query("learning_curve", "N8")
def _(t):
    return rounded(models.learning_curve(binary(t), "doc_id", "quality", "classification", "logistic"))


@query("feature_distributions", "N7 D22 D11")
def _(t):
    from tablewright.operators import histograms, summary
    best = [r["column"] for r in summary.top_variance(t.lineitem, 6).collect()]
    return histograms.histogram(t.lineitem, best, 30)


@query("correlation_of_most_variable", "N7 D14", """
SELECT 'l_quantity' AS feature1, 'l_extendedprice' AS feature2, round(r, 6) AS correlation FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) WHERE abs(r) > 0.7""")
def _(t):
    from tablewright.operators.correlation import correlation_of_most_variable
    return rounded(correlation_of_most_variable(t.lineitem))
