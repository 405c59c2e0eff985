"""A/B tests, runs, versions, deployments, alerts, audit, limits and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded
from tablewright.catalog.tables import union_all
from tablewright.operators import admission, experiments as ex, operations as op, ordered

WEIGHTS = {"control": 0.5, "treatment": 0.3, "b": 0.2}
BUCKET = ("list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: concat('0x', substr(md5('checkout:' || user_id), i * 4 + 1, 4))::BIGINT)), "
          "lambda a, p: (a * 65536 + p) % 1000)")
ASSIGN = f"(CASE WHEN {BUCKET} / 1000.0 <= 0.5 THEN 'control' WHEN {BUCKET} / 1000.0 <= 0.8 THEN 'treatment' ELSE 'b' END)"


@query("ab_assign", "O1", f"SELECT user_id, {ASSIGN} AS variant FROM (SELECT DISTINCT user_id FROM events)")
def _(t):
    return t.events.select("user_id").distinct().withColumn("variant", ex.ab_assign("checkout", F.col("user_id"), WEIGHTS))


RESULTS = f"""(SELECT variant, count(*) AS request_count, count(*) FILTER (WHERE event_type <> 'error') AS success_count,
  count(*) FILTER (WHERE event_type = 'error') AS error_count, count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate,
  sum(value) FILTER (WHERE event_type <> 'error') / count(*) FILTER (WHERE event_type <> 'error') AS avg_latency_ms,
  count(*) FILTER (WHERE event_type = 'purchase') AS conversions,
  count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type <> 'error') AS conversion_rate
FROM (SELECT *, {ASSIGN} AS variant FROM events) GROUP BY variant)"""


def results(t):
    e = F.col("event_type")
    return ex.ab_results(t.events, "checkout", WEIGHTS, "user_id", e != "error", e == "purchase", F.col("value"))


@query("ab_results", "O2 D31", f"""
SELECT variant, request_count, success_count, error_count, round(error_rate, 6) AS error_rate, round(avg_latency_ms, 6) AS avg_latency_ms,
  conversions, round(conversion_rate, 6) AS conversion_rate, CASE variant WHEN 'control' THEN 0.5 WHEN 'treatment' THEN 0.3 ELSE 0.2 END AS weight
FROM {RESULTS}""")
def _(t):
    return rounded(results(t).drop("position"))


@query("ab_winner", "O3", f"""
SELECT v.variant, round((v.conversion_rate - c.conversion_rate) / c.conversion_rate, 6) AS lift FROM {RESULTS} v,
  (SELECT * FROM {RESULTS} WHERE variant = 'control') c, (SELECT sum(request_count) AS n FROM {RESULTS})
WHERE v.variant <> 'control' AND n > 100 AND c.success_count >= 50 AND v.success_count >= 50
  AND (v.conversion_rate - c.conversion_rate) / c.conversion_rate > 0.01 ORDER BY lift DESC LIMIT 1""")
def _(t):
    return rounded(ex.ab_winner(results(t), "control", min_lift=0.01))


# -- runs ---------------------------------------------------------------------------------

def runs(t):
    accuracy, f1 = 1 - F.col("o_totalprice") / 1e6, 1 - F.col("o_totalprice") / 2e6
    absent = F.col("o_orderkey") % 10 == 0
    return t.orders.select(
        F.col("o_orderpriority").alias("experiment"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"),
        F.when(absent, F.create_map(F.lit("accuracy"), accuracy)).otherwise(
            F.create_map(F.lit("accuracy"), accuracy, F.lit("f1"), f1)).alias("metrics"),
        F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("depth"), (F.col("o_custkey") % 7).cast("string")).alias("params"))


RUNS = """(SELECT o_orderpriority AS experiment, o_orderkey AS run_id, o_orderdate AS created_at, 1 - o_totalprice / 1e6 AS accuracy,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 1 - o_totalprice / 2e6 END AS f1, o_orderstatus AS status, (o_custkey % 7)::VARCHAR AS depth FROM orders)"""
RUN_METRICS = f"""(SELECT experiment, run_id, 'accuracy' AS metric, accuracy AS value FROM {RUNS}
  UNION ALL SELECT experiment, run_id, 'f1', f1 FROM {RUNS} WHERE f1 IS NOT NULL)"""


@query("metrics_summary", "D30 O4", f"""
SELECT experiment, metric, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  count(*) AS count FROM {RUN_METRICS} GROUP BY ALL""")
def _(t):
    return rounded(ex.metrics_summary(runs(t)))


@query("best_run", "E9", f"""
SELECT experiment, run_id, round(f1, 6) AS value FROM {RUNS} WHERE f1 IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY f1 DESC, created_at, run_id) = 1""")
def _(t):
    return rounded(ex.best_run(runs(t), "f1"))


@query("worst_run", "E9", f"""
SELECT experiment, run_id, round(accuracy, 6) AS value FROM {RUNS}
QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY accuracy, created_at, run_id) = 1""")
def _(t):
    return rounded(ex.best_run(runs(t), "accuracy", higher_is_better=False))


@query("get_runs", "F2 O4", f"""
SELECT run_id, created_at::VARCHAR AS created_at, round(accuracy, 6) AS accuracy FROM {RUNS} WHERE experiment = '2-HIGH'
ORDER BY created_at DESC, run_id LIMIT 20""")
def _(t):
    out = ex.get_runs(runs(t), "2-HIGH", limit=20)
    return rounded(out.select("run_id", F.col("created_at").cast("string").alias("created_at"), F.col("metrics")["accuracy"].alias("accuracy")))


@query("compare_runs", "C5 O5", f"""
SELECT metric, round(max(value) FILTER (WHERE run_id = a), 6) AS first_run, round(max(value) FILTER (WHERE run_id = b), 6) AS last_run
FROM {RUN_METRICS}, (SELECT min(run_id) AS a, max(run_id) AS b FROM {RUNS} WHERE experiment = '2-HIGH') WHERE run_id IN (a, b) GROUP BY metric""")
def _(t):
    r = runs(t)
    ids = r.where("experiment = '2-HIGH'").agg(F.min("run_id").alias("a"), F.max("run_id").alias("b")).first()
    out = ex.compare_runs(r, "2-HIGH", [ids["a"], ids["b"]])
    return rounded(out.select("metric", F.col(str(ids["a"])).alias("first_run"), F.col(str(ids["b"])).alias("last_run")))


@query("search_runs", "O6", f"""
SELECT run_id, round(accuracy, 6) AS accuracy FROM {RUNS} WHERE accuracy > 0.9 AND status = 'F' ORDER BY accuracy DESC, run_id LIMIT 50""")
def _(t):
    out = ex.search_runs(runs(t), "metrics['accuracy'] > 0.9 AND params['status'] = 'F'", ["metrics['accuracy'] DESC", "run_id"], 50)
    return rounded(out.select("run_id", F.col("metrics")["accuracy"].alias("accuracy")))


@query("experiment_report", "O4", f"""
WITH b AS (SELECT experiment, run_id, accuracy FROM {RUNS} QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY accuracy DESC, created_at, run_id) = 1)
SELECT r.experiment, count(*) AS total_runs, min(created_at)::VARCHAR AS created_at, max(created_at)::VARCHAR AS updated_at, any_value(b.run_id) AS best_run,
  round(any_value(b.accuracy), 6) AS best_value FROM {RUNS} r JOIN b USING (experiment) GROUP BY r.experiment""")
def _(t):
    out = ex.experiment_report(runs(t))
    return rounded(out.withColumn("created_at", F.col("created_at").cast("string")).withColumn("updated_at", F.col("updated_at").cast("string")))


@query("run_timeline", "O4", f"SELECT run_id, created_at::VARCHAR AS created_at, round(f1, 6) AS primary_metric FROM {RUNS} WHERE experiment = '5-LOW'")
def _(t):
    return rounded(ex.timeline(runs(t), "5-LOW", "f1").withColumn("created_at", F.col("created_at").cast("string")))


# -- versions -------------------------------------------------------------------------------

def versions(t):
    from pyspark.sql.window import Window as W
    rank = F.row_number().over(W.partitionBy(F.col("s_nationkey") % 3).orderBy("s_suppkey"))
    return t.supplier.select(
        (F.col("s_nationkey") % 3).alias("name"), rank.alias("version"), "s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "FAILED").otherwise("READY").alias("status"),
        F.element_at(F.array(F.lit("Staging"), F.lit("Production"), F.lit("None")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("stage"),
        F.md5((F.floor(F.col("s_acctbal") / 2500)).cast("bigint").cast("string")).alias("hash"),
        F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("balance"), F.col("s_acctbal"), F.lit("key"), F.col("s_suppkey").cast("double")))
        .otherwise(F.create_map(F.lit("balance"), F.col("s_acctbal"))).alias("metrics"),
        F.create_map(F.lit("parity"), (F.col("s_suppkey") % 2).cast("string"), F.lit("kind"), F.lit("x")).alias("params"))


VERSIONS = """(SELECT s_nationkey % 3 AS name, row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_suppkey) AS version, s_suppkey, s_acctbal,
  CASE WHEN s_suppkey % 4 = 0 THEN 'FAILED' ELSE 'READY' END AS status, ['Staging', 'Production', 'None'][(s_suppkey % 3 + 1)::INT] AS stage,
  md5(floor(s_acctbal / 2500)::BIGINT::VARCHAR) AS hash FROM supplier)"""


@query("latest_version", "O9", f"SELECT name, max(version) AS version FROM {VERSIONS} GROUP BY name")
def _(t):
    return ex.latest_version(versions(t))


@query("latest_in_stage", "O9", f"SELECT name, max(version) AS version FROM {VERSIONS} WHERE stage = 'Production' GROUP BY name")
def _(t):
    return ex.latest_version(versions(t), "Production")


@query("list_versions", "O9", f"SELECT name, version, status FROM {VERSIONS} WHERE stage = 'Production' AND status = 'READY'")
def _(t):
    return ex.listing(versions(t), ["version", "name"], {"stage": "Production", "status": "READY"}).select("name", "version", "status")


@query("compare_versions", "C4 O8", f"""
SELECT 'balance' AS key, a.s_acctbal AS a, b.s_acctbal AS b, round(b.s_acctbal - a.s_acctbal, 6) AS diff FROM {VERSIONS} a JOIN {VERSIONS} b USING (name)
WHERE name = 0 AND a.version = 1 AND b.version = 2
UNION ALL SELECT 'key', CASE WHEN a.s_suppkey % 2 = 0 THEN a.s_suppkey END, CASE WHEN b.s_suppkey % 2 = 0 THEN b.s_suppkey END,
  CASE WHEN a.s_suppkey % 2 = 0 AND b.s_suppkey % 2 = 0 THEN b.s_suppkey - a.s_suppkey END FROM {VERSIONS} a JOIN {VERSIONS} b USING (name)
WHERE name = 0 AND a.version = 1 AND b.version = 2 AND (a.s_suppkey % 2 = 0 OR b.s_suppkey % 2 = 0)""")
def _(t):
    return rounded(ex.compare_versions(versions(t), 0, 1, 2))


@query("changed_params", "O8", f"""
SELECT 'parity' AS key, (a.s_suppkey % 2)::VARCHAR AS a, (b.s_suppkey % 2)::VARCHAR AS b FROM {VERSIONS} a JOIN {VERSIONS} b USING (name)
WHERE name = 0 AND a.version = 1 AND b.version = 2 AND a.s_suppkey % 2 <> b.s_suppkey % 2""")
def _(t):
    return ex.changed_params(versions(t), 0, 1, 2)


@query("production_rollback_target", "E8", f"""
WITH p AS (SELECT name, max(version) AS current FROM {VERSIONS} GROUP BY name)
SELECT name, current, max(version) AS target FROM {VERSIONS} JOIN p USING (name) WHERE status = 'READY' AND version < current GROUP BY ALL""")
def _(t):
    v = versions(t)
    return rounded(ex.production_rollback_target(v, ex.latest_version(v)))


@query("dedupe_by_hash", "O10", f"SELECT name, hash, min(version) AS version FROM {VERSIONS} GROUP BY ALL")
def _(t):
    return rounded(ex.dedupe_by_hash(versions(t)))


STAGES = ["Staging", "Production", "Archived"]
TRANSITIONS = """(SELECT o_custkey % 20 AS name, o_custkey % 7 AS version, ['Staging', 'Production', 'Archived'][(o_orderkey % 3 + 1)::INT] AS stage,
  o_orderkey AS tm FROM orders)"""


@query("current_stages", "O7", f"""
WITH tr AS {TRANSITIONS}, own AS (SELECT name, version, arg_max(stage, tm) AS stage, max(tm) AS tm FROM tr GROUP BY ALL)
SELECT name, version, CASE WHEN stage IN ('Staging', 'Production') AND EXISTS (SELECT 1 FROM tr WHERE tr.name = own.name AND tr.stage = own.stage
  AND tr.version <> own.version AND tr.tm > own.tm) THEN 'Archived' ELSE stage END AS stage FROM own""")
def _(t):
    log = t.orders.select((F.col("o_custkey") % 20).alias("name"), (F.col("o_custkey") % 7).alias("version"),
                          F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("stage"),
                          F.col("o_orderkey").alias("at"))
    return ex.current_stages(log)


DEPLOYS = """(SELECT o_orderpriority AS environment, o_orderkey AS deployment_id, o_orderdate AS tm,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'rollback' ELSE 'deployed' END AS kind FROM orders)"""


def deploys(t):
    kind = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "rollback").otherwise("deployed")
    return t.orders.select(F.col("o_orderpriority").alias("environment"), F.col("o_orderkey").alias("deployment_id"),
                           F.col("o_orderdate").alias("at"), kind.alias("kind"))


@query("deployment_states", "O11", f"""
SELECT environment, deployment_id, CASE WHEN nk IS NULL THEN 'active' WHEN nk = 'rollback' THEN 'rolled_back' ELSE 'superseded' END AS state FROM (
SELECT *, lead(kind) OVER (PARTITION BY environment ORDER BY tm, deployment_id) AS nk FROM {DEPLOYS} WHERE kind <> 'failed')
UNION ALL SELECT environment, deployment_id, 'failed' FROM {DEPLOYS} WHERE kind = 'failed'""")
def _(t):
    return ex.deployment_states(deploys(t))


@query("list_deployments", "O11 O12", f"""
SELECT deployment_id, tm::VARCHAR AS "at" FROM {DEPLOYS} WHERE environment = '1-URGENT' AND kind = 'rollback' ORDER BY tm DESC, deployment_id DESC LIMIT 20""")
def _(t):
    rows = ex.listing(deploys(t), ["at", "deployment_id"], {"environment": "1-URGENT", "kind": "rollback"}, 20)
    return rows.select("deployment_id", F.col("at").cast("string").alias("at"))


@query("deployment_states_retried", "O11", """
WITH e AS (SELECT o_orderpriority AS environment, o_custkey AS deployment_id, o_orderkey AS tm,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'rollback' ELSE 'deployed' END AS kind FROM orders),
s AS (SELECT environment, deployment_id, tm, lead(kind) OVER (PARTITION BY environment ORDER BY tm, deployment_id) AS nk FROM e WHERE kind <> 'failed'),
a AS (SELECT environment, deployment_id, tm, CASE WHEN nk IS NULL THEN 'active' WHEN nk = 'rollback' THEN 'rolled_back' ELSE 'superseded' END AS state FROM s
  UNION ALL SELECT environment, deployment_id, tm, 'failed' FROM e WHERE kind = 'failed')
SELECT environment, deployment_id, arg_max(state, tm) AS state FROM a GROUP BY ALL""")
def _(t):
    events = t.orders.select(
        F.col("o_orderpriority").alias("environment"), F.col("o_custkey").alias("deployment_id"), F.col("o_orderkey").alias("at"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "rollback").otherwise("deployed").alias("kind"))
    return ex.deployment_states(events)


@query("active_deployments", "O11", f"""
SELECT environment, deployment_id FROM {DEPLOYS} WHERE kind <> 'failed'
QUALIFY row_number() OVER (PARTITION BY environment ORDER BY tm DESC, deployment_id DESC) = 1""")
def _(t):
    return ex.active_deployments(deploys(t))


@query("rollback_targets", "E7", f"""
SELECT environment, deployment_id, row_number() OVER (PARTITION BY environment ORDER BY tm DESC, deployment_id DESC) - 1 AS rank FROM {DEPLOYS}
QUALIFY rank BETWEEN 1 AND 9""")
def _(t):
    return rounded(ex.rollback_targets(deploys(t), "environment", ["at", "deployment_id"]).select("environment", "deployment_id", "rank"))


@query("rollback_statistics", "O12 D31", """
WITH r AS (SELECT o_orderstatus = 'F' AS success, o_orderpriority AS reason, (o_custkey % 3)::VARCHAR AS environment FROM orders)
SELECT d AS dimension, v AS value, count(*) AS n, count(*) FILTER (WHERE success) AS successful, round(count(*) FILTER (WHERE success) / count(*), 6) AS success_rate
FROM (SELECT success, 'total' AS d, 'all' AS v FROM r UNION ALL SELECT success, 'reason', reason FROM r UNION ALL SELECT success, 'environment', environment FROM r)
GROUP BY ALL""")
def _(t):
    r = t.orders.select((F.col("o_orderstatus") == "F").alias("success"), F.col("o_orderpriority").alias("reason"),
                        (F.col("o_custkey") % 3).cast("string").alias("environment"))
    return rounded(ex.rollback_statistics(r))


# -- latency -------------------------------------------------------------------------------

EDGES = op.LATENCY_BUCKETS
SECONDS = "value / 25.0"
BUCKETS = f"""(SELECT g.le, g.lo, g.i, count(v.s) AS n, sum(v.s) AS s FROM (SELECT unnest([{", ".join(map(str, EDGES))}, 'inf'::DOUBLE]) AS le,
  unnest([0.0, {", ".join(map(str, EDGES))}]) AS lo, unnest(range(12)) AS i) g LEFT JOIN (SELECT {SECONDS} AS s FROM events) v
  ON v.s <= g.le AND (g.i = 0 OR v.s > g.lo) GROUP BY ALL)"""


@query("latency_percentiles", "D32", f"""
WITH b AS (SELECT *, sum(n) OVER (ORDER BY i) AS cum, sum(n) OVER () AS total FROM {BUCKETS})
SELECT max(total)::BIGINT AS count, round(sum(s) / sum(n) * 1000, 4) AS mean_ms, round(min((le + lo) / 2) FILTER (WHERE cum >= total * 0.5) * 1000, 4) AS p50_ms,
  round(min((le + lo) / 2) FILTER (WHERE cum >= total * 0.95) * 1000, 4) AS p95_ms, round(min((le + lo) / 2) FILTER (WHERE cum >= total * 0.99) * 1000, 4) AS p99_ms FROM b""")
def _(t):
    return rounded(op.latency_percentiles(t.events, F.col("value") / 25.0), 4)


@query("cumulative_histogram", "D33", f"""
SELECT CASE WHEN i = 11 THEN '+Inf' ELSE le::VARCHAR END AS le, (sum(n) OVER (ORDER BY i))::BIGINT AS cumulative FROM {BUCKETS}""")
def _(t):
    return op.cumulative_histogram(t.events, F.col("value") / 25.0)


@query("request_summary", "D32 L9", """
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS error,
  round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate, count(*) FILTER (WHERE event_type = 'view') AS cache_hits,
  count(*) FILTER (WHERE event_type <> 'view') AS cache_misses, round(count(*) FILTER (WHERE event_type = 'view') / count(*), 6) AS hit_rate FROM events GROUP BY user_id""")
def _(t):
    e = F.col("event_type")
    return rounded(op.request_summary(t.events, e != "error", e == "view", ["user_id"]))


@query("last_n_latency", "E6", """
SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS mean_latency FROM (SELECT * FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY event_type""")
def _(t):
    return rounded(op.last_n_latency(t.events, "event_type", [F.col("ts").desc(), F.col("event_id").desc()], F.col("value")))


@query("count_by", "D31", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(t):
    return op.count_by(t.orders, "o_orderstatus")


# -- alerts --------------------------------------------------------------------------------

ALERTS = """(SELECT event_type AS rule, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'info' ELSE 'warning' END AS severity,
  CASE WHEN value > 99 THEN 'firing' ELSE 'resolved' END AS status, ts AS fired_at FROM events)"""
AS_OF = "(SELECT max(ts) FROM events)"


def alerts(t):
    e = F.col("event_type")
    return t.events.select(e.alias("rule"), F.when(e == "error", "critical").when(e == "purchase", "info").otherwise("warning").alias("severity"),
                           F.when(F.col("value") > 99, "firing").otherwise("resolved").alias("status"), F.col("ts").alias("fired_at"))


def newest(t):
    return F.lit(t.events.agg(F.max("ts").alias("m")).first()["m"])


@query("alert_statistics", "P1 D31", f"""
SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM {ALERTS} UNION ALL SELECT 'severity', severity, count(*) FROM {ALERTS} GROUP BY severity
UNION ALL SELECT 'rule', rule, count(*) FROM {ALERTS} GROUP BY rule UNION ALL SELECT 'active', 'all', count(*) FROM {ALERTS} WHERE status = 'firing' HAVING count(*) > 0
UNION ALL SELECT 'last_24h', 'all', count(*) FROM {ALERTS} WHERE fired_at > {AS_OF} - INTERVAL 24 HOURS""")
def _(t):
    return op.alert_statistics(alerts(t), newest(t))


@query("active_alerts", "P2", f"SELECT rule, severity, fired_at::VARCHAR AS fired_at FROM {ALERTS} WHERE status = 'firing' AND severity = 'warning'")
def _(t):
    return op.active_alerts(alerts(t), "warning").select("rule", "severity", F.col("fired_at").cast("string").alias("fired_at"))


@query("alert_states", "P2", """
SELECT o_custkey AS alert_id, arg_max(kind, o_orderkey) AS state, max(o_orderkey) AS since, count(*) AS n_events
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'acknowledged' ELSE 'fired' END AS kind FROM orders) GROUP BY o_custkey""")
def _(t):
    kind = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "acknowledged").otherwise("fired")
    return op.alert_states(t.orders.select(F.col("o_custkey").alias("alert_id"), kind.alias("kind"), F.col("o_orderkey").alias("at")))


@query("alert_history", "P2", f"SELECT rule, fired_at::VARCHAR AS fired_at FROM (SELECT * FROM {ALERTS} ORDER BY fired_at DESC LIMIT 100)")
def _(t):
    return op.alert_history(alerts(t)).select("rule", F.col("fired_at").cast("string").alias("fired_at"))


HEALTH = f"""(SELECT a AS active_alerts, c AS critical, greatest(0, least(100, 100.0 - CASE WHEN c > 0 THEN 30.0 * c ELSE 10.0 * a END - 20)) AS health_score,
  CASE WHEN c > 0 THEN 'critical' WHEN a > 0 THEN 'warning' ELSE 'healthy' END AS base FROM (SELECT count(*) FILTER (WHERE status = 'firing') AS a,
  count(*) FILTER (WHERE status = 'firing' AND severity = 'critical') AS c FROM {ALERTS}))"""


@query("health_overview", "P3", f"""
SELECT active_alerts, critical, health_score::DOUBLE AS health_score, CASE WHEN health_score < 50 THEN 'critical' WHEN health_score < 80 THEN 'warning' ELSE base END AS status FROM {HEALTH}""")
def _(t):
    return op.health_overview(alerts(t), F.lit(True), F.lit(0.4))


@query("alert_timeline", "P4 B6", f"""
SELECT severity, count(*) AS n FROM {ALERTS} WHERE fired_at > {AS_OF} - INTERVAL 72 HOURS GROUP BY severity""")
def _(t):
    return op.alert_timeline(alerts(t), newest(t), 72)


SNAPSHOTS = "(SELECT event_type AS metric, ts AS tm, value FROM events)"


@query("metric_timeline", "P4", f"""
SELECT tm::VARCHAR AS "at", value FROM {SNAPSHOTS} WHERE metric = 'click' AND tm > {AS_OF} - INTERVAL 24 HOURS""")
def _(t):
    snapshots = t.events.select(F.col("event_type").alias("metric"), F.col("ts").alias("at"), "value")
    return op.metric_timeline(snapshots, "click", newest(t)).withColumn("at", F.col("at").cast("string"))


@query("monitoring_report", "P5 P3", f"""
SELECT active_alerts, critical, health_score::DOUBLE AS health_score, CASE WHEN health_score < 50 THEN 'critical' WHEN health_score < 80 THEN 'warning' ELSE base END AS status,
  (SELECT count(*) FROM {ALERTS}) AS total_alerts, (SELECT count(*) FROM {ALERTS} WHERE fired_at > {AS_OF} - INTERVAL 24 HOURS) AS last_24h, true AS degraded, 0.4 AS drift_rate,
  CASE WHEN (SELECT count(*) FROM {ALERTS} WHERE fired_at > {AS_OF} - INTERVAL 24 HOURS) > 10 THEN 'Alerts are frequent: set the limits anew.; ' ELSE '' END
  || 'Drift in many checks: compare the inputs with the training data.; Metrics are below the baseline: train again.' AS recommendations FROM {HEALTH}""")
def _(t):
    out = op.monitoring_report(alerts(t), newest(t), F.lit(True), F.lit(0.4))
    return out.withColumn("recommendations", F.array_join("recommendations", "; "))


DAILY = "(SELECT ts::DATE AS d, count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate FROM events GROUP BY 1)"


@query("alert_rules_with_cooldown", "L6 U1 P1", f"""
WITH RECURSIVE r AS (SELECT unnest(['high_error_rate', 'any_error']) AS rule, unnest([0.19, 0.15]) AS thr, unnest([2, 3]) AS cool),
c AS (SELECT rule, cool, d, row_number() OVER (PARTITION BY rule ORDER BY d) AS rn FROM {DAILY}, r WHERE error_rate > thr),
f AS (SELECT rule, cool, rn, d, true AS fires, d AS last FROM c WHERE rn = 1
  UNION ALL SELECT c.rule, c.cool, c.rn, c.d, c.d >= f.last + c.cool::INT, CASE WHEN c.d >= f.last + c.cool::INT THEN c.d ELSE f.last END FROM f JOIN c ON c.rule = f.rule AND c.rn = f.rn + 1)
SELECT rule, d::VARCHAR AS fired_on FROM f WHERE fires""")
def _(t):
    from tablewright.streaming.alerts import AlertRule, evaluate_rules
    daily = t.events.groupBy(F.col("ts").cast("date").cast("timestamp").alias("at")).agg(
        (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("error_rate"))
    rules = [AlertRule("high_error_rate", "error_rate > 0.19", "critical", 2 * 86_400), AlertRule("any_error", "error_rate > 0.15", "warning", 3 * 86_400)]
    fired = evaluate_rules(daily, rules, "at")
    return fired.select("rule", F.timestamp_micros("t").cast("date").cast("string").alias("fired_on"))


# -- admission ---------------------------------------------------------------------------

def admitted_sql(limit: int, seconds: int, key: str = "user_id", table: str = "events", time: str = "epoch_us(ts)") -> str:
    return f"""(SELECT k AS key, list_reduce(list_prepend([]::BIGINT[], list_transform(ts, lambda x: [x])), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda a: a > x[1] - {seconds * 1_000_000}::BIGINT)) < {limit} THEN list_concat(acc, x) ELSE acc END) AS acc, len(ts) AS n
  FROM (SELECT {key} AS k, list({time} ORDER BY {time}) AS ts FROM {table} GROUP BY {key}))"""


@query("sliding_window_limit", "L7", f"""
SELECT key AS user_id, n::BIGINT AS requests, len(acc)::BIGINT AS accepted FROM {admitted_sql(3, 86_400)}""")
def _(t):
    out = admission.sliding_window_limit(t.events, "user_id", "ts", 3, 86_400)
    return out.groupBy(F.col("key").alias("user_id")).agg(F.sum("requests").alias("requests"), F.sum("accepted").alias("accepted"))


@query("sliding_window_admitted_times", "L7", f"SELECT key AS user_id, unnest(acc) AS t FROM {admitted_sql(2, 43_200)}")
def _(t):
    out = admission.sliding_window_limit(t.events, "user_id", "ts", 2, 43_200)
    return out.where("accepted > 0").select(F.col("key").alias("user_id"), "t")


@query("raw_window_counts", "L7", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS window_count FROM events""")
def _(t):
    return admission.raw_window_counts(t.events, "user_id", "ts", 86_400).select("event_id", "window_count")


@query("request_limits", "L7", """
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 1000 WHEN starts_with(url, 'https://m.') THEN 20 ELSE 100 END AS max_requests,
  CASE WHEN page_id % 10 = 0 THEN 10 WHEN starts_with(url, 'https://m.') THEN 30 ELSE 60 END AS window_seconds FROM pages""")
def _(t):
    key = F.when(F.col("page_id") % 10 == 0, "vip").otherwise("std")
    pair = admission.limit_of(key, F.col("url"), {"vip": (1000, 10)}, {"https://m.": (20, 30)})
    return t.pages.select("page_id", pair.alias("p")).select("page_id", F.col("p.limit").alias("max_requests"), F.col("p.window").alias("window_seconds"))


# -- audit ----------------------------------------------------------------------------------

CHAIN = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
h AS (SELECT user_id, event_id, rn, substr(sha256('genesis:' || event_id || ':' || ts), 1, 32) AS chain_hash FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, substr(sha256(h.chain_hash || ':' || e.event_id || ':' || e.ts), 1, 32) FROM h JOIN e ON e.user_id = h.user_id AND e.rn = h.rn + 1)"""


def chained(t):
    return op.chain_write(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", F.col("ts"))


@query("chain_hash", "L10 H14", CHAIN + " SELECT event_id, chain_hash FROM h")
def _(t):
    return chained(t).select("event_id", "chain_hash")


@query("chain_verify", "E10", CHAIN + """, c AS (SELECT event_id, user_id, rn, CASE WHEN event_id % 1000 = 7 THEN 'x' || chain_hash ELSE chain_hash END AS s FROM h),
n AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY rn) AS following FROM c)
SELECT event_id FROM c WHERE event_id % 1000 = 7 UNION SELECT following FROM n WHERE event_id % 1000 = 7 AND following IS NOT NULL""")
def _(t):
    broken = F.when(F.col("event_id") % 1000 == 7, F.concat(F.lit("x"), F.col("chain_hash"))).otherwise(F.col("chain_hash"))
    return op.chain_verify(chained(t).withColumn("chain_hash", broken), ["user_id"], "ts", "event_id", F.col("ts")).select("event_id")


AUDIT = """(SELECT event_id, ts, user_id, CASE event_type WHEN 'error' THEN 'auth.login_failed' WHEN 'purchase' THEN 'model.train' ELSE 'data.access' END AS action,
  value <= 90 AS success FROM events)"""
SEVERITY = "CASE WHEN action = 'auth.login_failed' THEN 'warning' WHEN NOT success THEN 'error' ELSE 'info' END"


def audit(t):
    from tablewright.functions.labels import audit_severity
    e = F.col("event_type")
    base = t.events.select("event_id", F.col("ts").alias("timestamp"), "user_id", F.when(e == "error", "auth.login_failed")
                           .when(e == "purchase", "model.train").otherwise("data.access").alias("action"), (F.col("value") <= 90).alias("success"))
    return base.withColumn("severity", audit_severity(F.col("action"), F.col("success")))


@query("audit_query", "B7 F8", f"""
SELECT event_id, action, {SEVERITY} AS severity FROM {AUDIT} WHERE action = 'data.access' AND {SEVERITY} = 'error' AND ts >= TIMESTAMP '2024-01-05'
  AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts::DATE DESC, ts, event_id LIMIT 100""")
def _(t):
    out = op.audit_query(audit(t), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"), "data.access", severity="error")
    return out.select("event_id", "action", "severity")


@query("audit_severity", "H19", f"SELECT {SEVERITY} AS severity, count(*) AS n FROM {AUDIT} GROUP BY 1")
def _(t):
    return audit(t).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("log_tail", "F7 L8", """
SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""")
def _(t):
    return op.log_tail(t.events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id")


@query("task_durations", "P6", """
SELECT event_type AS type, count(*) AS n, count(done) AS finished, round(avg(epoch_us(done) - epoch_us(ts)) / 1e6, 4) AS mean_seconds,
  round(max(epoch_us(done) - epoch_us(ts)) / 1e6, 4) AS max_seconds
FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events) GROUP BY event_type""")
def _(t):
    tasks = ordered.next_value(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", ["event_id"], "ts", "done")
    return rounded(op.task_durations(tasks, "event_type", "ts", "done"), 4)


# -- drift history ---------------------------------------------------------------------------

HISTORY = """(SELECT o_orderkey AS check_id, o_orderdate AS tm, o_orderstatus = 'F' AS drift_detected, o_totalprice / 5e5 AS score,
  list_filter([CASE WHEN o_custkey % 2 = 0 THEN 'even' END, CASE WHEN o_custkey % 3 = 0 THEN 'third' END, o_orderpriority], lambda x: x IS NOT NULL) AS columns FROM orders)"""


def history(t):
    k = F.col("o_custkey")
    return t.orders.select(
        F.col("o_orderkey").alias("check_id"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").alias("drift_detected"),
        (F.col("o_totalprice") / 5e5).alias("score"), F.array_compact(F.array(
            F.when(k % 2 == 0, "even"), F.when(k % 3 == 0, "third"), F.col("o_orderpriority"))).alias("columns"))


@query("drift_history_report", "E12", f"""
SELECT (SELECT count(*) FROM orders) AS total_checks, count(*) AS recent_checks, round(avg(drift_detected::INT), 6) AS drift_rate
FROM (SELECT * FROM {HISTORY} ORDER BY tm DESC, check_id DESC LIMIT 100)""")
def _(t):
    return rounded(op.drift_history_report(history(t), 100))


@query("most_drifted_columns", "E12", f"""
SELECT c AS "column", count(*) AS n FROM (SELECT unnest(columns) AS c FROM (SELECT * FROM {HISTORY} ORDER BY tm DESC, check_id DESC LIMIT 100))
GROUP BY c ORDER BY n DESC, c LIMIT 10""")
def _(t):
    return op.most_drifted_columns(history(t), 100)


@query("drift_timeline", "E12 B6", f"""
SELECT check_id, drift_detected, round(score, 6) AS score, len(columns)::BIGINT AS drifted_columns FROM {HISTORY}
WHERE tm > (SELECT max(o_orderdate) FROM orders) - INTERVAL 720 HOURS""")
def _(t):
    last = F.lit(t.orders.agg(F.max("o_orderdate").alias("m")).first()["m"])
    return rounded(op.drift_timeline(history(t), last, 720).drop("at"))
