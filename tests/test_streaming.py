"""Streams give the batch answer; detectors match their definitions; late rows are dropped."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.sources import feature_sets, logs, tables
from tablewright.streaming import delayed, detectors, monitoring, runner
from tablewright.streaming.runner import drain


def naive_window(values, delta=0.002):
    """The rule as stated: every split from the left, at least five values on both sides, one cut per update."""
    window, flags = [], []
    for v in values:
        window.append(v)
        hit = False
        if len(window) >= 10:
            for i in range(5, len(window) - 4):
                left, right = window[:i], window[i:]
                m = 1.0 / (1.0 / len(left) + 1.0 / len(right))
                if abs(np.mean(left) - np.mean(right)) > np.sqrt(np.log(4.0 / delta) / (2 * m)):
                    window, hit = window[i:], True
                    break
        flags.append((hit, len(window)))
    return flags


@pytest.fixture(scope="module")
def shifts():
    rng = np.random.default_rng(4)
    return np.concatenate([rng.normal(0, 1, 150), rng.normal(4, 1, 120), rng.normal(-3, 2, 100)])


def test_adaptive_window(spark, shifts):
    d = detectors.AdaptiveWindow()
    assert [(d.update(v), d.size) for v in shifts] == naive_window(shifts)
    df = spark.createDataFrame(pd.DataFrame({"f": "a", "t": range(len(shifts)), "id": range(len(shifts)), "v": shifts})).repartition(6)
    got = detectors.adaptive_window(df, "f", "t", "id", "v", exact_width=1000).orderBy("id").collect()
    assert [(r["drift"], r["width"]) for r in got] == naive_window(shifts)
    got = detectors.adaptive_window(df, "f", "t", "id", "v").orderBy("id").collect()
    assert [(r["drift"], r["width"]) for r in got] == naive_buckets(shifts)


def naive_buckets(values, delta=0.002):
    """Buckets as lists of raw values, oldest first; all borders tried from the left."""
    buckets, flags = [], []
    for v in values:
        buckets.append([v])
        size = 1
        while len(same := [i for i, b in enumerate(buckets) if len(b) == size]) > 5:
            i, j = same[:2]
            buckets[i:j + 1] = [buckets[i] + buckets[j]]
            size *= 2
        hit = False
        for k in range(1, len(buckets)):
            left, right = sum(buckets[:k], []), sum(buckets[k:], [])
            if min(len(left), len(right)) >= 5 and abs(np.mean(left) - np.mean(right)) > np.sqrt(
                    np.log(4.0 / delta) / 2 * (1 / len(left) + 1 / len(right))):
                buckets, hit = buckets[k:], True
                break
        flags.append((hit, sum(map(len, buckets))))
    return flags


def test_bucket_window_is_small_and_finds_the_cuts_of_the_exact_one(shifts):
    window = detectors.BucketWindow()
    for _ in range(1_000_000 // 997 + 1):  # quiet values
        for x in range(997):
            window.update(0.5 + (x % 7) * 1e-3)
    assert window.size >= 1_000_000 and len(window.sums) * 12 < 2048  # eight bytes of sum, four of level
    assert window.update(0.5) is False
    exact, rough = detectors.AdaptiveWindow(), detectors.BucketWindow()
    cuts = [[i for i, v in enumerate(shifts) if w.update(v)] for w in (exact, rough)]
    for border in (150, 270):  # the series shifts here; both see it within a few values
        assert [next(i for i in c if i >= border) - border < 15 for c in cuts] == [True, True]
    assert abs(exact.size - rough.size) <= 40


def test_exact_window_keeps_at_most_its_width():
    window = detectors.AdaptiveWindow(width=50)
    sizes = [(window.update(0.1), window.size)[1] for _ in range(130)]
    assert max(sizes) == 50 and sizes[-1] == 50


@pytest.mark.parametrize("chunk,alpha", [(7, 0.9999), (64, 0.9), (64, 1.0), (100_000, 0.9999)])
def test_page_hinkley_batch(spark, shifts, chunk, alpha):
    d = detectors.PageHinkley(threshold=20.0, alpha=alpha)
    want = []
    for v in shifts:
        hit = d.update(v)
        want.append((hit, d.total))
    df = spark.createDataFrame(pd.DataFrame({"f": "a", "t": np.arange(len(shifts)) * 1_000_000, "id": range(len(shifts)), "v": shifts})).repartition(6)
    got = detectors.page_hinkley(df, "f", "t", "id", "v", threshold=20.0, alpha=alpha, chunk=chunk, seconds=40).orderBy("id").collect()
    assert np.allclose([r["total"] for r in got], [w[1] for w in want])
    assert [r["drift"] for r in got] == [w[0] for w in want]


def write_parts(spark, pdf, folder, parts):
    """Several files, so that a stream sees several micro-batches in file order."""
    edges = np.linspace(0, len(pdf), parts + 1).astype(int)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        spark.createDataFrame(pdf.iloc[a:b]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame(pdf.head(1)).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_online_detectors_over_several_batches(spark, shifts, folder):
    n = len(shifts)
    pdf = pd.DataFrame({"f": "a", "t": np.arange(n), "id": np.arange(n), "v": shifts})
    out = drain(detectors.online_detectors(write_parts(spark, pdf, f"{folder}/in", 4), "f", "t", "id", "v", threshold=20.0)).orderBy("id").collect()
    d, w = detectors.PageHinkley(threshold=20.0), detectors.BucketWindow()
    assert [(r["adwin_drift"], r["ph_drift"]) for r in out] == [(w.update(v), d.update(v)) for v in shifts]


def test_performance_over_several_batches(spark, folder):
    rng = np.random.default_rng(1)
    n = 900
    pdf = pd.DataFrame({"m": "a", "t": np.arange(n), "id": np.arange(n), "a": rng.choice(list("xyz"), n), "p": rng.choice(list("xyz"), n)})
    s = monitoring.streaming_performance(write_parts(spark, pdf, f"{folder}/in", 3), "m", "t", "id", "a", "p", window=200)
    out = drain(s, "update").orderBy("batch").collect()
    tail = pdf.tail(200)
    assert len(out) == 3 and np.isclose(out[-1]["accuracy"], (tail["a"] == tail["p"]).mean())


def test_counters_equal_batch(spark, folder):
    pdf = pd.DataFrame({"m": list("aabbbc") * 5, "ok": [True, False, True] * 10, "l": np.arange(30.0)})
    stream = write_parts(spark, pdf, f"{folder}/in", 3)
    got = {r["model"]: r["requests"] for r in drain(monitoring.counters(stream, "m", F.col("ok"), F.col("l")), "complete").collect()}
    assert got == pdf["m"].value_counts().to_dict()


def test_late_rows_are_dropped(spark, folder):
    at = pd.to_datetime(["2024-01-01 00:10", "2024-01-01 05:00", "2024-01-01 09:00", "2024-01-01 00:20", "2024-01-01 09:30", "2024-01-02 00:00"])
    pdf = pd.DataFrame({"ts": at, "v": 1.0})
    # six files in order: 00:20 arrives after 09:00 has moved the watermark beyond its window
    s = monitoring.tumbling(write_parts(spark, pdf, f"{folder}/in", 6), "ts", "1 hour", [], {"n": F.count(F.lit(1))})
    got = {r["start"].strftime("%H"): r["n"] for r in drain(s).collect()}
    assert got["00"] == 1 and got["05"] == 1


def test_drift_windows_flag_the_shifted_day(spark):
    rng = np.random.default_rng(0)
    ref = spark.createDataFrame(pd.DataFrame({"v": rng.normal(size=2000)}))
    at = pd.date_range("2024-01-01", periods=400, freq="7min")
    events = spark.createDataFrame(pd.DataFrame({"ts": at, "v": np.where(at.day == 2, 3.0, rng.normal(size=400))}))
    got = {str(r["start"])[:10]: r["psi"] for r in monitoring.windowed_drift(events, ref, "ts", "v", "1 day").collect()}
    assert got["2024-01-02"] > 0.2 > got["2024-01-01"]


def test_sources(spark, folder):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "id int, s string, x double")
    for name in ("t.csv", "t.parquet"):
        assert tables.load(spark, tables.write(df, f"{folder}/{name}")).orderBy("id").collect()[1]["s"] is None
    df.write.json(f"{folder}/t.json")
    assert tables.load(spark, f"{folder}/t.json").count() == 2
    assert tables.load_many(spark, [f"{folder}/t.csv", f"{folder}/t.json"]).count() == 4
    assert [r["column"] for r in tables.dataset_columns(spark, f"{folder}/t.csv").orderBy("position").collect()] == ["id", "s", "x"]
    with pytest.raises(ValueError):
        tables.load(spark, f"{folder}/t.xyz")
    with pytest.raises(FileNotFoundError):
        tables.load(spark, f"{folder}/none.parquet")


def test_bad_log_lines_are_skipped(spark, folder):
    with open(f"{folder}/a.jsonl", "w") as f:
        f.write('{"timestamp": "t1", "level": "INFO", "message": "m", "meta": {"a": "1"}}\nnot json\n{"level": "WARN"}\n')
    assert [r["level"] for r in logs.read_jsonl(spark, f"{folder}/a.jsonl").collect()] == ["INFO", "WARN"]


def test_feature_store_versions(spark, folder):
    store = feature_sets.FeatureStore(spark, f"{folder}/store")
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, x double")
    assert store.write("s", df, ["id"]) == 1 and store.write("s", df.limit(1), ["id"], None) == 2
    assert store.versions("s") == [1, 2] and store.read("s").count() == 1 and store.read("s", 1).count() == 2
    info = store.info("s").orderBy("version").collect()
    assert [r["n_rows"] for r in info] == [2, 1] and info[0]["data_hash"] != info[1]["data_hash"]
    assert store.read("s", 1, ["x", "gone"], {"id": 2}, ["id"]).collect()[0].asDict() == {"id": 2, "x": 3.0}


def test_a_rule_with_an_unknown_column_is_passed_over_but_errors_are_raised(spark):
    from pyspark.errors import AnalysisException

    from tablewright.streaming.alerts import AlertRule, candidates
    df = spark.createDataFrame([(0.5,)], "error_rate double")
    rules = [AlertRule("absent", "accuracy < 0.8"), AlertRule("high", "error_rate > 0.1")]
    assert [r["rule"] for r in candidates(df, rules).collect()] == ["high"]
    with pytest.raises(AnalysisException):
        candidates(df, [AlertRule("typo", "no_such_function(error_rate) > 1")])


def test_delayed_truth_lets_every_prediction_out(spark, folder):
    start = pd.Timestamp("2024-01-01")
    p = pd.DataFrame({"k": [1, 2, 3, 4, 5, 5, None, 1], "ts": [start + pd.Timedelta(hours=h) for h in (0, 1, 2, 30, 31, 31, 3)] + [None],
                      "score": [0.5 + i for i in range(8)]})
    a = pd.DataFrame({"k": [1, 1, 2, 4, 5, None], "seen": [start + pd.Timedelta(hours=h) for h in (2, 24, 30, 30.5, 54.9, 4)], "truth": [10, 11, 20, 40, 50, 90]})
    a = pd.concat([a, pd.DataFrame({"k": [4], "seen": [start + pd.Timedelta(hours=29)], "truth": [39]})])  # before its prediction

    def stream(pdf, ddl, name):
        path = f"{folder}/{name}"
        rows = [tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r) for r in pdf.itertuples(index=False)]
        for i, part in enumerate((rows[:3], rows[3:])):
            spark.createDataFrame([(None if r[0] is None else int(r[0]), *r[1:]) for r in part], ddl).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path), spark.read.schema(ddl).parquet(path)

    ps, pb = stream(p, "k bigint, ts timestamp, score double", "p")
    as_, ab = stream(a, "k bigint, seen timestamp, truth bigint", "a")
    markers, close = runner.marker_stream(spark)
    got = drain(delayed.delayed_truth(ps, as_, "k", "ts", "seen", lateness="3 days", closing=markers), closing=close)
    want = monitoring.delayed_ground_truth(pb, ab, "k", "ts", "seen")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 9


def test_a_drain_has_no_time_limit_of_its_own():
    import inspect
    assert inspect.signature(drain).parameters["timeout"].default is None
