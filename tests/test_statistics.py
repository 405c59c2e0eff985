"""Statistics against pandas and NumPy, and independence from partitioning."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.text import date_like_columns
from tablewright.operators import categories, correlation, evaluation, histograms, summary, trends
from tablewright.operators.quantiles import exact_quantiles
from tablewright.plans import dashboard, profile, suggest


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 3000
    return pd.DataFrame({
        "skewed": np.exp(rng.normal(size=n)), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)),
        "ints": rng.integers(0, 9, n).astype(float), "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
        "flat": np.full(n, 3.0), "g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05])})


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("ranges", [1, 256])
def test_quantiles(spark, frame, rows_by, parts, ranges):
    df = spark.createDataFrame(frame).repartition(parts)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.951, "e": 1.0}
    got = rows_by(exact_quantiles(df, ["skewed", "hot", "ints", "gaps", "flat"], probs, ranges=ranges), "column")
    for c in got:
        for name, p in probs.items():
            assert math.isclose(got[c][name], frame[c].quantile(p), rel_tol=1e-12, abs_tol=1e-12), (c, p)


def test_quantiles_by_group(spark, frame, rows_by):
    df = spark.createDataFrame(frame)
    got = rows_by(exact_quantiles(df, ["skewed", "gaps"], {"m": 0.5}, ["g"]), "g", "column")
    for (g, c), r in got.items():
        assert math.isclose(r["m"], frame.loc[frame.g == g, c].median(), rel_tol=1e-12)


def test_quantiles_of_empty_and_single(spark, rows_by):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "x double, y double")
    got = rows_by(exact_quantiles(df, ["x", "y"], {"m": 0.5}), "column")
    assert set(got) == {"y"} and got["y"]["m"] == 1.0


def test_summary_and_shape(spark, frame, rows_by):
    df = spark.createDataFrame(frame)
    s, h = rows_by(summary.numeric_summary(df), "column"), rows_by(summary.shape(df), "column")
    for c in ["skewed", "hot", "ints", "gaps"]:
        assert math.isclose(s[c]["mean"], frame[c].mean(), rel_tol=1e-9)
        assert math.isclose(s[c]["std"], frame[c].std(), rel_tol=1e-9)
        assert s[c]["n"] == frame[c].count()
        assert math.isclose(h[c]["skewness"], frame[c].skew(), rel_tol=1e-7, abs_tol=1e-9)
        assert math.isclose(h[c]["kurtosis"], frame[c].kurt(), rel_tol=1e-7, abs_tol=1e-9)


def test_summary_of_an_empty_column(spark, rows_by):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    got = rows_by(summary.numeric_summary(df), "column")
    assert got["y"]["n"] == 0 and got["y"]["mean"] is None and got["y"]["median"] is None


def test_nan_is_missing(spark, rows_by):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert rows_by(summary.null_counts(df), "column")["x"]["nulls"] == 2
    assert rows_by(summary.numeric_summary(df), "column")["x"]["mean"] == 1.0


@pytest.mark.parametrize("bins", [10, 20])
def test_histogram_like_numpy(spark, frame, bins):
    df = spark.createDataFrame(frame)
    rows = histograms.histogram(df, ["skewed", "ints", "gaps", "flat"], bins).collect()
    for c in ["skewed", "ints", "gaps", "flat"]:
        want, edges = np.histogram(frame[c].dropna(), bins=bins)
        got = sorted((r["bin"], r["n"], r["bin_start"]) for r in rows if r["column"] == c)
        assert [g[1] for g in got] == want.tolist()
        assert np.allclose([g[2] for g in got], edges[:-1])


def test_histogram_edges_fall_right(spark):
    values = [i * 0.1 for i in range(11)] + [0.3, 0.7, 0.6000000000000001]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["n"] for r in histograms.histogram(df, ["x"], 10).orderBy("bin").collect()]
    assert got == np.histogram(values, bins=10)[0].tolist()


def test_two_hundred_columns_with_gaps_take_one_scan(spark, capsys):
    rng = np.random.default_rng(5)
    n, k = 400, 200
    x = rng.normal(size=(n, 1)) * rng.normal(size=k) + rng.normal(size=(n, k)) * rng.uniform(0.1, 3, k) + 10.0 ** rng.integers(0, 9, k)
    x[rng.random((n, k)) < 0.2] = np.nan
    x[:, 7] = 0.1  # no spread
    x[::3, 8], x[1::3, 8], x[2::3, 8] = 0.3, np.nan, 0.3  # none where others are present
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])
    df = spark.createDataFrame(pdf).repartition(5)
    pairs = correlation.correlation_pairs(df)
    # one read of the rows: all that is aggregated afterwards are moments
    pairs.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    got = {(r["feature1"], r["feature2"]): r["correlation"] for r in pairs.collect()}
    want = pdf.corr()
    assert len(got) == 198 * 197 // 2
    for (a, b), r in got.items():
        assert math.isclose(r, want.loc[a, b], rel_tol=1e-6, abs_tol=1e-7)


def test_correlation_with_infinite_distant_and_empty_values(spark):
    inf, nan = float("inf"), float("nan")
    a = [1e9 + i for i in range(50)] + [None] * 3
    b = [float(i * i) for i in range(50)] + [1.0, 2.0, 3.0]
    c = [inf] + [float(i) for i in range(49)] + [5.0, 6.0, 9.0]
    d = [None] * 50 + [1.0, 2.0, 4.0]
    df = spark.createDataFrame(list(zip(a, b, c, d)), "a double, b double, c double, d double").repartition(4)
    got = {(r["feature1"], r["feature2"]): r["correlation"] for r in correlation.correlation_pairs(df).collect()}
    plain = np.corrcoef(np.arange(50), b[:50])[0, 1]
    assert set(got) == {("a", "b"), ("b", "d"), ("c", "d")} and math.isclose(got["a", "b"], plain, rel_tol=1e-9)
    target = correlation.correlation_with_target(df, "b", 9).collect()
    assert [(r["column"], round(r["abs_correlation"], 9)) for r in target[:1]] == [("b", 1.0)] and {r["column"] for r in target} == {"a", "b", "d"}
    assert correlation.correlation_pairs(df.limit(0)).collect() == []


def test_correlations(spark, frame):
    df = spark.createDataFrame(frame)
    want = frame[["skewed", "hot", "ints", "gaps"]].corr()
    for r in correlation.correlation_matrix(df, ["skewed", "hot", "ints", "gaps"]).collect():
        assert math.isclose(r["correlation"], want.loc[r["feature1"], r["feature2"]], rel_tol=1e-8, abs_tol=1e-12)
    assert correlation.correlation_pairs(df, ["skewed", "flat"]).count() == 0


def test_crosstab(spark, frame):
    small = frame.assign(k=(frame["ints"] > 4).astype(int).astype(str))
    want = pd.crosstab(small["g"], small["k"], normalize="index") * 100
    for r in categories.crosstab(spark.createDataFrame(small), "g", "k").collect():
        assert math.isclose(r["row_pct"], want.loc[r["category"], r["target"]], abs_tol=1e-9)


def test_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "x string")
    assert categories.modes(df, ["x"]).first()["mode"] == "a"
    assert [r["value"] for r in categories.value_counts(df, "x", 2).collect()] == ["a", "b"]


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert summary.duplicate_rows(df).first().asDict() == {"n_rows": 3, "n_distinct": 2, "duplicate_rows": 1}


def test_profile_of_five_people(spark, rows_by):
    df = spark.createDataFrame([(25.0, 50000, "NYC"), (30.0, 60000, "LA"), (35.0, 70000, "NYC"), (40.0, 80000, "LA"), (None, 90000, "NYC")],
                               "age double, income long, city string")
    p = rows_by(profile.profile(df), "column")
    assert [c for c in p if p[c]["kind"] == "numeric"] == ["age", "income"] or {c for c in p if p[c]["kind"] == "numeric"} == {"age", "income"}
    assert p["city"]["n_unique"] == 2 and p["age"]["nulls"] == 1 and p["age"]["mean"] == 32.5
    one = profile.profile_summary(df).first()
    assert (one["n_rows"], one["numeric_columns"], one["categorical_columns"]) == (5, 2, 1)


def test_detect_target(spark):
    df = spark.createDataFrame([(1, 100, 0), (2, 200, 1), (3, 300, 0)], "age long, income long, target long")
    for rule in ("token", "common_name", "cardinality"):
        assert profile.detect_target(profile.profile(df), rule).first()[0] == "target"
    plain = spark.createDataFrame([(i, i * 2) for i in range(30)], "aa long, bb long")
    assert profile.detect_target(profile.profile(plain)).first()[0] == "bb"


def test_suggested_steps_run(spark):
    from tablewright.operators.cleaning import run_steps
    df = spark.createDataFrame([(25.0, 50000, "NYC", 0), (None, 60000, "LA", 1), (35.0, 70000, None, 0), (40.0, 80000, "LA", 1), (45.0, 90000, "NYC", 0)],
                               "age double, income long, city string, target long")
    rows = profile.profile(df)
    steps = suggest.suggest_steps(rows, profile.profile_summary(df), "target")
    specs = suggest.step_specs(steps)
    assert [s["type"] for s in specs] == ["impute", "impute", "encode", "scale"]
    out = run_steps(df, specs).toPandas()
    assert out.isnull().sum().sum() == 0 and abs(out["income"].mean()) < 1e-9


def test_models_are_ranked(spark):
    df = spark.createDataFrame([(i, float(i * i), i % 2) for i in range(50)], "a long, b double, target long")
    c = suggest.dataset_complexity(df, profile.profile(df), "target")
    ranked = suggest.rank_models(c, "classification").orderBy("rank").collect()
    assert ranked[0]["model"] == "LogisticRegression" and ranked[0]["score"] == 80.0 and ranked[0]["is_recommended"]
    assert suggest.recommendation_reason(c).first()[0] == "fits because of: small dataset size"


def test_dashboard_parts(spark, sf):
    parts = dashboard.dashboard(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderstatus")
    assert {"kpis", "insights", "trends", "top_correlations", "target_by_o_orderpriority"} <= set(parts)
    assert parts["kpis"].count() == 6


def test_zscore_anomalies_skip_constant_columns(spark):
    ref = spark.createDataFrame([("x", 0.0, 1.0), ("y", 5.0, 0.0)], "column string, mean double, std double")
    df = spark.createDataFrame([(4.0, 5.0), (0.5, 6.0)], "x double, y double")
    assert [r.asDict() for r in summary.zscore_anomalies(df, ref).collect()] == [{"column": "x", "n": 2, "anomalies": 1, "max_z": 4.0}]


def test_approximate_distinct(spark):
    df = spark.range(10_000).select((F.col("id") % 100).alias("x"))
    assert abs(summary.distinct_counts(df, approximate=True).first()["n_unique"] - 100) <= 8


@pytest.mark.parametrize("ranges", [1, 256])
def test_quantiles_of_infinite_values(spark, ranges):
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    x[:400], x[400:1000] = np.inf, -np.inf
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    row = exact_quantiles(df, ["x"], {"a": 0.05, "b": 0.5, "c": 0.75, "d": 0.99}, ranges=ranges).first()
    s = np.sort(x)
    assert row.a == -np.inf and row.d == np.inf and row.n == 4000
    assert math.isclose(row.b, (s[1999] + s[2000]) / 2, rel_tol=1e-12)
    assert math.isclose(row.c, s[2999] + (s[3000] - s[2999]) * 0.25, rel_tol=1e-12)


def test_metrics_with_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (1e6, None), (None, 4.0)], "actual double, pred double")
    row = evaluation.regression_metrics(df).first()
    assert row.sample_count == 3 and math.isclose(row.r2_score, 1 - 0.02 / (2 / 3), rel_tol=1e-9)
    labels = spark.createDataFrame([("a", "a"), (None, "a"), (None, None)], "actual string, pred string")
    cells = {(r["actual"], r["pred"]): r["n"] for r in evaluation.confusion_matrix(labels).collect()}
    assert cells == {("a", "a"): 1, (None, "a"): 1, (None, None): 1, ("a", None): 0}
    per = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in evaluation.per_class_metrics(labels).collect()}
    assert per == {"a": (0.5, 1.0, 1), None: (1.0, 0.5, 2)}


def test_nothing_is_cut_unasked(spark):
    rows = [(i, f"2024-01-{i % 28 + 1:02d}", f"2024-01-{i % 28 + 1:02d}" if i != 150 else "no date", *[float(i * k) for k in range(8)]) for i in range(200)]
    names = [f"n{k}" for k in range(8)]
    df = spark.createDataFrame(rows, "id long, day string, almost string, " + ", ".join(f"{n} double" for n in names))
    assert date_like_columns(df) == ["day"]
    assert {r["column"] for r in trends.resample(df, "day", None).select("column").distinct().collect()} == {"id", *names}
    assert dashboard.key_statistics(profile.profile(df)).count() == 9
    many = spark.range(60).select(F.col("id").cast("string").alias("actual"), F.col("id").cast("string").alias("pred"))
    assert evaluation.per_class_metrics(many).count() == 60 and evaluation.class_distribution(many).count() == 120
    assert evaluation.per_class_metrics(many, top=7).count() == 7
