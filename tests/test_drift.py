"""Drift formulas against direct NumPy computation, p-values against known values, invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.pvalues import chi2_tail, exact_ks, kolmogorov_tail, upper_gamma
from tablewright.operators import drift


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(42)
    ref = pd.DataFrame({"feature1": rng.normal(size=1000), "feature2": rng.normal(size=1000), "kind": rng.choice(list("abc"), 1000)})
    cur = pd.DataFrame({"feature1": rng.normal(0.5, 1.5, 1000), "feature2": rng.normal(size=1000), "kind": rng.choice(list("abd"), 1000)})
    return ref, cur


@pytest.fixture(scope="module")
def frames(spark, pair):
    return spark.createDataFrame(pair[0]).repartition(5), spark.createDataFrame(pair[1]).repartition(3)


def shares(ref, cur, bins=10):
    edges = np.linspace(min(ref.min(), cur.min()), max(ref.max(), cur.max()), bins + 1)
    a, b = np.histogram(ref, edges)[0], np.histogram(cur, edges)[0]
    return (a + 1) / (a.sum() + bins), (b + 1) / (b.sum() + bins)


def test_numeric_divergences(pair, frames, rows_by):
    bins = drift.numeric_bins(*frames)
    for c in ["feature1", "feature2"]:
        p, q = shares(pair[0][c], pair[1][c])
        m = (p + q) / 2
        want = {"psi": ((q - p) * np.log(q / p)).sum(), "kl_divergence": (p * np.log(p / q)).sum(),
                "js_divergence": 0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum()}
        for method, value in want.items():
            assert math.isclose(rows_by(drift.divergence(bins, method, "numeric"), "column")[c]["score"], value, rel_tol=1e-9)


def test_categorical_floor(pair, frames):
    a, b = pair[0]["kind"].value_counts(normalize=True), pair[1]["kind"].value_counts(normalize=True)
    want = sum((max(b.get(c, 0), 1e-4) - max(a.get(c, 0), 1e-4)) * math.log(max(b.get(c, 0), 1e-4) / max(a.get(c, 0), 1e-4)) for c in "abcd")
    got = drift.divergence(drift.category_counts(*frames), "psi", "categorical").first()["score"]
    assert math.isclose(got, want, rel_tol=1e-9)


def brute_ks(a, b):
    grid = np.sort(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()


def test_ks_statistic(pair, frames, rows_by):
    got = rows_by(drift.ks_two_sample(*frames), "column")
    for c in ["feature1", "feature2"]:
        assert math.isclose(got[c]["score"], brute_ks(pair[0][c].to_numpy(), pair[1][c].to_numpy()), rel_tol=1e-12)
    assert got["feature1"]["p_value"] < 1e-6 < got["feature2"]["p_value"]


def test_ks_with_a_hot_value_and_nulls(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random(2000) < 0.5, 1.0, rng.normal(size=2000))
    b = np.where(rng.random(900) < 0.3, 1.0, rng.normal(size=900))
    ra = spark.createDataFrame([(float(x),) for x in a] + [(None,)] * 50, "x double")
    rb = spark.createDataFrame([(float(x),) for x in b] + [(float("nan"),)] * 50, "x double")
    assert math.isclose(drift.ks_two_sample(ra, rb).first()["score"], brute_ks(a, b), rel_tol=1e-12)


def test_same_data_does_not_drift(frames):
    ref, _ = frames
    for r in drift.detect_drift(ref, ref, list(drift.THRESHOLDS)).where("error IS NULL").collect():
        assert abs(r["score"]) < 1e-12 and not r["drift_detected"], r


def test_js_is_symmetric_and_bounded(frames, rows_by):
    ref, cur = frames
    one = rows_by(drift.divergence(drift.numeric_bins(ref, cur), "js_divergence", "numeric"), "column")
    two = rows_by(drift.divergence(drift.numeric_bins(cur, ref), "js_divergence", "numeric"), "column")
    for c in one:
        assert math.isclose(one[c]["score"], two[c]["score"], rel_tol=1e-9) and 0 <= one[c]["score"] <= math.log(2)


def test_detect_drift_report(frames):
    report = drift.detect_drift(*frames)
    verdict = {r["column"]: r["drift_detected"] for r in drift.column_verdicts(report).collect()}
    assert verdict == {"feature1": True, "feature2": False, "kind": True}
    errors = report.where("error IS NOT NULL").collect()
    assert [(e["column"], e["method"]) for e in errors] == [("kind", "ks_test")]
    assert drift.overall_drift(report).first()["columns_with_drift"] == ["feature1", "kind"]


def test_flat_column_scores_zero(spark):
    df = spark.createDataFrame([(2.0,)] * 30, "x double")
    assert drift.divergence(drift.numeric_bins(df, df.limit(10)), "psi", "numeric").first()["score"] == 0.0


def test_unknown_method_is_refused(frames):
    with pytest.raises(ValueError):
        drift.detect_drift(*frames, methods=["nope"])


def test_unequal_sums_count_as_no_drift(frames, rows_by):
    ref, cur = frames
    got = rows_by(drift.check_drift(ref, cur.where("kind <> 'd'")), "column")
    assert got["kind"]["sums_match"] is False and got["kind"]["score"] == 0.0
    assert rows_by(drift.check_drift(ref, cur), "column")["kind"]["sums_match"] is True


def test_known_tails(spark):
    assert math.isclose(upper_gamma(0.5, 3.841458820694124 / 2), 0.05, rel_tol=1e-9)
    assert math.isclose(upper_gamma(5.0, 18.307038053275146 / 2), 0.05, rel_tol=1e-9)
    assert math.isclose(upper_gamma(10.0, 2.0), 0.9999535, rel_tol=1e-6)
    row = spark.range(1).select(
        chi2_tail(F.lit(9.487729036781154), F.lit(4)).alias("chi"),
        kolmogorov_tail(F.lit(1.3580986 / math.sqrt(500)), F.lit(1000), F.lit(1000)).alias("ks")).first()
    assert math.isclose(row["chi"], 0.05, rel_tol=1e-9) and math.isclose(row["ks"], 0.05, rel_tol=1e-4)


def test_degradation_polarity(spark, rows_by):
    base = spark.createDataFrame([("accuracy", 0.9), ("rmse", 10.0), ("mae", 1.0)], "metric string, value double")
    now = spark.createDataFrame([("accuracy", 0.8), ("rmse", 10.5), ("other", 1.0)], "metric string, value double")
    got = rows_by(drift.degradation(base, now), "metric")
    assert set(got) == {"accuracy", "rmse"} and got["accuracy"]["degraded"] and not got["rmse"]["degraded"]


def test_baseline_check(spark, rows_by):
    rng = np.random.default_rng(3)
    base = spark.createDataFrame([("x", 0.0, 1.0), ("y", 0.0, 1.0)], "column string, mean double, std double")
    share = spark.createDataFrame([("k", "a", 0.5), ("k", "b", 0.5)], "column string, value string, share double")
    cur = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=2000), "y": rng.normal(2, 1, 2000), "k": rng.choice(["a", "b"], 2000)}))
    got = rows_by(drift.baseline_check(base, share, cur), "column")
    assert not got["x"]["drift_detected"] and got["y"]["drift_detected"] and not got["k"]["drift_detected"]


def test_exact_ks_law_equals_enumeration():
    from itertools import combinations
    for n1, n2 in ((1, 1), (3, 3), (4, 6), (5, 7), (8, 8), (8, 3)):
        seen = {}
        for where in combinations(range(n1 + n2), n1):
            i = j = 0
            top = 0
            for k in range(n1 + n2):
                i, j = (i + 1, j) if k in where else (i, j + 1)
                top = max(top, abs(i * n2 - j * n1))
            seen[top] = seen.get(top, 0) + 1
        total = sum(seen.values())
        for d in seen:
            want = sum(c for x, c in seen.items() if x >= d) / total
            assert math.isclose(exact_ks(d / (n1 * n2), n1, n2), want, abs_tol=1e-12)
    # critical values of the published tables: at most 5 % beyond them, more than 5 % one step before
    for n, steps in ((5, 5), (10, 7), (20, 9), (30, 11)):
        assert exact_ks(steps / n, n, n) <= 0.05 < exact_ks((steps - 1) / n, n, n)
    assert exact_ks(0.0, 5, 5) == 1.0 and 0 < exact_ks(0.02, 9000, 10_000) < 1 and exact_ks(1.0, 200, 300) < 1e-11
    assert math.isclose(exact_ks(1.5 / math.sqrt(5000), 10_000, 10_000), 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * 2.25) for k in range(1, 20)), rel_tol=0.03)


def test_p_values_are_exact_for_small_sides(spark):
    a = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    b = spark.createDataFrame([(float(x),) for x in (3.5, 5, 6)], "x double")
    row = drift.ks_two_sample(a, b).first()
    assert math.isclose(row["score"], 0.75) and math.isclose(row["p_value"], exact_ks(0.75, 4, 3))


def test_a_stored_reference_gives_the_batch_report_and_is_read_once(spark, frames, folder):
    ref, cur = frames
    methods = list(drift.THRESHOLDS)
    want = sorted(map(str, drift.detect_drift(ref, cur, methods).collect()))
    kept = drift.DriftReference.store(ref, f"{folder}/kept")
    assert sorted(map(str, kept.detect(cur, methods).collect())) == want
    one, two = ref.randomSplit([0.5, 0.5], seed=3)
    parts = drift.DriftReference.store(one, f"{folder}/parts")
    parts.add(two)
    assert sorted(map(str, parts.detect(cur, methods).collect())) == want
    # the bins of the method on its own scan agree with those of the counts
    alone = {(r["column"], r["method"]): r["score"] for r in drift.detect_drift(ref, cur, ["psi", "js_divergence"]).collect()}
    counted = {(r["column"], r["method"]): r["score"] for r in kept.detect(cur, ["psi", "js_divergence"]).collect()}
    assert alone.keys() == counted.keys() and all(math.isclose(v, counted[k], abs_tol=1e-12) for k, v in alone.items())


def test_micro_batches_do_not_read_the_reference_again(spark, folder):
    from tablewright.streaming import monitoring
    rng = np.random.default_rng(2)
    spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=300)})).write.parquet(f"{folder}/ref")
    for _ in range(3):
        spark.createDataFrame(pd.DataFrame({"x": rng.normal(1, 1, size=200)})).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    reference = spark.read.parquet(f"{folder}/ref").mapInArrow(counted, "x double")
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    monitoring.periodic_drift_check(stream, reference, f"{folder}/out", f"{folder}/cp", ["psi", "ks_test"]).awaitTermination()
    reports = spark.read.parquet(f"{folder}/out")
    assert reports.select("batch").distinct().count() == 3 and reports.where("drift_detected").count() == 6
    assert reads.value == 300
