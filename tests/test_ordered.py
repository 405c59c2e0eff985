"""Ordered operators, joins, limits and chains against brute force, with a hot key."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import admission, experiments, joins, operations, ordered, sampling


@pytest.fixture(scope="module")
def log():
    """One key holds over half of the rows; times repeat."""
    rng = np.random.default_rng(9)
    n = 1500
    return pd.DataFrame({"k": np.where(rng.random(n) < 0.55, 0, rng.integers(1, 6, n)), "t": rng.integers(0, 40_000, n) * 1_000_000,
                         "id": np.arange(n), "v": rng.normal(size=n)}).sort_values(["k", "t", "id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def frame(spark, log):
    return spark.createDataFrame(log).repartition(7)


def values(df, name):
    return [r[name] for r in df.orderBy("k", "t", "id").collect()]


@pytest.mark.parametrize("seconds", [7_000, 10_000_000])
def test_previous_next_and_numbers(frame, log, seconds):
    g = log.groupby("k")
    prev = values(ordered.previous_value(frame, ["k"], "t", ["id"], "id", "p", seconds), "p")
    assert [None if pd.isna(x) else int(x) for x in g["id"].shift(1)] == prev
    following = values(ordered.next_value(frame, ["k"], "t", ["id"], "id", "p", seconds), "p")
    assert [None if pd.isna(x) else int(x) for x in g["id"].shift(-1)] == following
    assert values(ordered.row_numbers(frame, ["k"], "t", ["id"], "rn", seconds), "rn") == (g.cumcount() + 1).tolist()


@pytest.fixture
def rush(spark, monkeypatch):
    """Nine rows in ten belong to one key and one hour, half of those to one second."""
    rng = np.random.default_rng(3)
    n = 4000
    hot = rng.random(n) < 0.9
    second = np.where(rng.random(n) < 0.5, 1800, rng.integers(0, 3600, n))
    log = pd.DataFrame({"k": np.where(hot, 0, rng.integers(1, 5, n)), "t": np.where(hot, second, rng.integers(0, 200_000, n)) * 1_000_000,
                        "id": rng.permutation(n), "v": rng.normal(size=n)}).sort_values(["k", "t", "id"]).reset_index(drop=True)
    monkeypatch.setattr(ordered, "TARGET_ROWS", 200)
    return log, spark.createDataFrame(log).repartition(5)


def test_no_piece_of_a_rush_hour_is_large_and_pieces_are_in_order(rush):
    log, frame = rush
    pieces = ordered.bucketed(frame, ["k"], "t", ["id"], 3600).groupBy("k", ordered.BUCKET).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi")).collect()
    assert max(r["n"] for r in pieces) <= 2 * 200 and sum(r["n"] for r in pieces) == len(log)
    mine = sorted((r[ordered.BUCKET], r["lo"], r["hi"]) for r in pieces if r["k"] == 0)
    assert len(mine) > 12 and all(a[2] < b[1] for a, b in zip(mine, mine[1:]))


def test_results_do_not_depend_on_the_pieces(rush, monkeypatch):
    log, frame = rush
    g = log.groupby("k")
    assert values(ordered.row_numbers(frame, ["k"], "t", ["id"], "rn", 3600), "rn") == (g.cumcount() + 1).tolist()
    prev = values(ordered.previous_value(frame, ["k"], "t", ["id"], "id", "p", 3600), "p")
    assert [None if pd.isna(x) else int(x) for x in g["id"].shift(1)] == prev
    following = values(ordered.next_value(frame, ["k"], "t", ["id"], "id", "p", 3600), "p")
    assert [None if pd.isna(x) else int(x) for x in g["id"].shift(-1)] == following
    monkeypatch.setattr(ordered, "MOST_CUTS", 8)  # fewer, larger pieces
    assert values(ordered.row_numbers(frame, ["k"], "t", ["id"], "rn", 3600), "rn") == (g.cumcount() + 1).tolist()


def test_point_in_time_join_in_a_rush_hour(rush, spark):
    log, frame = rush
    left = frame.where("id % 3 = 0").select("k", "t", "id")
    right = frame.where("id % 3 <> 0").select("k", "t", F.col("id").alias("f"))
    got = {r["id"]: r["f"] for r in joins.point_in_time_join(left, right, ["k"], "t", bucket_seconds=3600).collect()}
    want, last = {}, {}
    for (k, t), rows in log.groupby(["k", "t"], sort=True):
        features = [i for i in rows["id"] if i % 3]
        if features:
            last[k] = max(features)
        want.update({i: last.get(k) for i in rows["id"] if i % 3 == 0})
    assert got == want


@pytest.mark.parametrize("chunk", [20, 33, 5000])
def test_rolling(frame, log, chunk):
    got = values(ordered.rolling(frame, ["k"], "t", ["id"], 20, {"m": F.avg("v"), "n": F.count("v")}, 3000, chunk), "m")
    want = log.groupby("k")["v"].rolling(20, min_periods=1).mean().to_numpy()
    assert np.allclose(got, want)


def test_latest_and_last_n(frame, log):
    got = {r["k"]: r["id"] for r in ordered.latest(frame, ["k"], "t", ["id"]).collect()}
    assert got == log.groupby("k")["id"].last().to_dict()
    kept = ordered.last_n(frame, ["k"], [F.col("t").desc(), F.col("id").desc()], 30).toPandas()
    assert set(kept["id"]) == set(log.groupby("k").tail(30)["id"])


@pytest.mark.parametrize("bucket", [500, 10_000_000])
def test_point_in_time_join(spark, bucket):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"e": np.where(rng.random(400) < 0.6, 1, rng.integers(2, 9, 400)), "t": rng.integers(0, 30_000, 400) * 1_000_000, "id": range(400)})
    right = pd.DataFrame({"e": np.where(rng.random(700) < 0.6, 1, rng.integers(2, 12, 700)), "t": rng.integers(0, 30_000, 700) * 1_000_000, "f": rng.normal(size=700)})
    right = right.sort_values(["t", "f"])
    want = pd.merge_asof(left.sort_values("t"), right, on="t", by="e").set_index("id")["f"]
    got = joins.point_in_time_join(spark.createDataFrame(left), spark.createDataFrame(right).repartition(5), ["e"], "t", bucket_seconds=bucket).toPandas()
    assert len(got) == 400
    got, want = got.set_index("id")["f"].reindex(range(400)), want.reindex(range(400))
    assert ((got == want) | (got.isna() & want.isna())).all()


def test_point_in_time_keeps_null_keys_and_equal_times(spark):
    left = spark.createDataFrame([(1, 5_000_000, "a"), (None, 5_000_000, "b"), (2, 1_000_000, "c")], "e long, t long, id string")
    right = spark.createDataFrame([(1, 5_000_000, 1.0), (1, 6_000_000, 2.0), (None, 1_000_000, 9.0), (2, 2_000_000, 3.0)], "e long, t long, f double")
    got = {r["id"]: r["f"] for r in joins.point_in_time_join(left, right, ["e"], "t").collect()}
    assert got == {"a": 1.0, "b": None, "c": None}


def brute_limit(log, limit, seconds):
    out = {}
    for k, part in log.groupby("k"):
        held = []
        for t in part["t"]:
            held = [x for x in held if x > t - seconds * 1_000_000]
            ok = len(held) < limit
            if ok:
                held.append(t)
            out[(k, t)] = out.get((k, t), 0) + ok
    return out


@pytest.mark.parametrize("limit,seconds", [(1, 60), (3, 500), (10, 100), (50, 4000), (1, 20_000)])
def test_sliding_window_limit(frame, log, limit, seconds):
    got = {(r["key"], r["t"]): r["accepted"] for r in admission.sliding_window_limit(frame, "k", "t", limit, seconds).collect()}
    assert got == brute_limit(log, limit, seconds)


def test_raw_window_counts(frame, log):
    got = values(admission.raw_window_counts(frame, "k", "t", 300), "window_count")
    want = []
    for _, part in log.groupby("k"):
        t = part["t"].to_numpy()
        want += [int(((t > x - 300_000_000) & (t <= x)).sum()) for x in t]
    assert got == want


def test_limit_choice(spark):
    df = spark.createDataFrame([("vip", "/x"), ("k", "/api/predict/1"), ("k", "/other")], "k string, p string")
    pair = admission.limit_of(F.col("k"), F.col("p"), {"vip": (9, 1)}, {"/api/predict": (20, 30)})
    assert [tuple(r[0]) for r in df.select(pair).collect()] == [(9, 1), (20, 30), (100, 60)]


def test_chain(spark, frame, log):
    written = operations.chain_write(frame, ["k"], "t", "id", F.col("t")).persist()
    want = {}
    for k, part in log.groupby("k"):
        h = "genesis"
        for t, i in zip(part["t"], part["id"]):
            h = hashlib.sha256(f"{h}:{i}:{t}".encode()).hexdigest()[:32]
            want[i] = h
    assert {r["id"]: r["chain_hash"] for r in written.select("id", "chain_hash").collect()} == want
    assert operations.chain_verify(written, ["k"], "t", "id", F.col("t"), 500).count() == 0
    hot = log[log.k == 0]["id"].tolist()
    broken = written.withColumn("chain_hash", F.when(F.col("id") == hot[10], "zz").otherwise(F.col("chain_hash")))
    assert {r["id"] for r in operations.chain_verify(broken, ["k"], "t", "id", F.col("t"), 500).collect()} == {hot[10], hot[11]}


def test_stage_archiving(spark):
    log = [("m", 1, "Staging", 1), ("m", 1, "Production", 2), ("m", 2, "Staging", 3), ("m", 2, "Production", 4), ("m", 3, "Staging", 5), ("m", 1, "Production", 6)]
    got = experiments.current_stages(spark.createDataFrame(log, "name string, version int, stage string, at int"))
    assert {r["version"]: r["stage"] for r in got.collect()} == {1: "Production", 2: "Archived", 3: "Staging"}


def test_deployments(spark):
    log = [("p", 1, "deployed", 1), ("p", 2, "deployed", 2), ("p", 3, "failed", 3), ("p", 1, "rollback", 4), ("s", 9, "deployed", 1)]
    df = spark.createDataFrame(log, "environment string, deployment_id int, kind string, at int")
    got = {(r["environment"], r["deployment_id"]): r["state"] for r in experiments.deployment_states(df).collect()}
    assert got == {("p", 1): "active", ("p", 2): "rolled_back", ("p", 3): "failed", ("s", 9): "active"}


def test_ab_split_follows_the_weights(spark):
    users = spark.range(20_000).select(experiments.ab_assign("x", F.col("id"), {"a": 1.0, "b": 3.0}).alias("v"))
    share = users.where("v = 'a'").count() / 20_000
    assert abs(share - 0.25) < 0.02


def test_split_and_sample_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    sides = []
    for n in (1, 13):
        train, test = sampling.train_test_split(df.repartition(n), "k")
        assert train.count() + test.count() == 5000 and train.join(test, "k").count() == 0
        sides.append({r["k"] for r in test.collect()})
    assert sides[0] == sides[1] and abs(len(sides[0]) - 1000) < 120
    assert {r["k"] for r in sampling.sample_n(df.repartition(9), "k", 50).collect()} == {r["k"] for r in sampling.sample_n(df, "k", 50).collect()}


def test_alert_rules(spark):
    from tablewright.streaming.alerts import DEFAULT_RULES, AlertRule, evaluate_rules
    rows = [(0, 0.5, 0.9), (600, 0.2, 0.5), (1000, 0.3, 0.9), (5000, 0.05, None)]
    df = spark.createDataFrame([(t * 1_000_000, e, a) for t, e, a in rows], "at long, error_rate double, accuracy double")
    fired = {(r["rule"], r["t"] // 1_000_000, r["severity"]) for r in evaluate_rules(df, DEFAULT_RULES, "at").collect()}
    assert fired == {("high_error_rate", 0, "critical"), ("high_error_rate", 1000, "critical"), ("low_accuracy", 600, "warning")}
    assert evaluate_rules(df, [AlertRule("off", "error_rate > 0", enabled=False)], "at").count() == 0


def test_latency_overflow_is_infinite(spark):
    df = spark.createDataFrame([(0.001,), (20.0,), (30.0,)], "s double")
    row = operations.latency_percentiles(df, F.col("s")).first()
    assert row["p50_ms"] == float("inf") and row["count"] == 3


def test_health(spark):
    a = spark.createDataFrame([("r", "critical", "firing"), ("r", "warning", "firing"), ("r", "info", "resolved")], "rule string, severity string, status string")
    row = operations.health_overview(a, F.lit(True), F.lit(0.6)).first()
    assert (row["health_score"], row["status"]) == (35.0, "critical")
    calm = operations.health_overview(a.where("status = 'resolved'"), F.lit(False), F.lit(0.0)).first()
    assert (calm["health_score"], calm["status"]) == (100.0, "healthy")


@pytest.mark.parametrize("seconds", [5, 1000])
def test_previous_and_next_value_keep_nulls(spark, seconds):
    df = spark.createDataFrame([("a", t, t, None if t % 3 == 0 else t) for t in range(30)], "k string, t long, id long, v long")
    for step, shift in ((ordered.previous_value, -1), (ordered.next_value, 1)):
        got = {r["id"]: r["w"] for r in step(df, ["k"], "t", ["id"], "v", "w", seconds).collect()}
        assert got == {t: t + shift if (t + shift) % 3 and 0 <= t + shift < 30 else None for t in range(30)}


def test_failed_deployment_that_went_live_later(spark):
    log = [("p", 1, "failed", 1), ("p", 1, "deployed", 2), ("p", 2, "deployed", 3), ("p", 2, "failed", 4)]
    df = spark.createDataFrame(log, "environment string, deployment_id int, kind string, at int")
    got = {r["deployment_id"]: r["state"] for r in experiments.deployment_states(df).collect()}
    assert got == {1: "superseded", 2: "failed"}


def test_online_features_without_time(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 9), (2, None, 1)], "id int, x string, y int")
    for n in (1, 5):
        got = {r["id"]: (r["x"], r["y"]) for r in joins.online_features(df.repartition(n), ["id"], None).collect()}
        assert got == {1: ("a", 9), 2: (None, 1)}
    tied = joins.online_features(df, ["id"], None, ["y"])
    assert tied.columns == df.columns and {r["id"]: r["y"] for r in tied.collect()} == {1: 5, 2: 1}
