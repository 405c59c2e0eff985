"""Streaming queries over the events table, drained by availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded
from tablewright.sources import logs, tables
from tablewright.streaming import alerts as al
from tablewright.streaming import delayed, detectors, monitoring
from tablewright.streaming.runner import drain, marker_stream, stream_table


def events(t):
    return stream_table(t.spark, t.sf_dir, "events")


PH = """WITH RECURSIVE e AS (SELECT event_type AS feature, event_id, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
h AS (SELECT feature, event_id, rn, v AS mean, 0.9999 * 0 + (v - v - 0.005) AS total, (v - v - 0.005) AS low FROM e WHERE rn = 1
  UNION ALL SELECT e.feature, e.event_id, e.rn, h.mean + (e.v - h.mean) / e.rn,
    0.9999 * h.total + (e.v - (h.mean + (e.v - h.mean) / e.rn) - 0.005), least(h.low, 0.9999 * h.total + (e.v - (h.mean + (e.v - h.mean) / e.rn) - 0.005))
  FROM h JOIN e ON e.feature = h.feature AND e.rn = h.rn + 1)"""


@query("page_hinkley", "L2", PH + " SELECT event_id, feature, round(total, 4) AS total, total - low > 50 AS drift FROM h")
def _(t):
    return rounded(detectors.page_hinkley(t.events, "event_type", "ts", "event_id", "value", chunk=500), 4)


def _window_sql() -> str:
    """The adaptive window in SQL: a list of buckets (newest first), one recursion step a value.

    Fourteen levels of joining are written out, enough for 5 * 2^14 values in a window.
    """
    state = "list_concat([{'n': 1::BIGINT, 's': e.v}], coalesce(h.kept, []::STRUCT(n BIGINT, s DOUBLE)[]))"
    source = f"(SELECT e.feature, e.event_id, e.rn, {state} AS b FROM @here)"
    for level in range(14):
        n = 2 ** level
        run = f"list_filter(b, lambda x: x.n = {n})"
        joined = (f"list_concat(list_concat(list_filter(b, lambda x: x.n < {n}), ({run})[1:4]), "
                  f"list_concat([{{'n': {2 * n}::BIGINT, 's': ({run})[5].s + ({run})[6].s}}], list_filter(b, lambda x: x.n > {n})))")
        source = f"(SELECT feature, event_id, rn, CASE WHEN len({run}) > 5 THEN {joined} ELSE b END AS b FROM {source})"
    sums, sizes = "list_transform(b, lambda x: x.s)", "list_transform(b, lambda x: x.n)"
    right = f"list_transform(range(1, len(b)), lambda k: {{'k': k, 'rs': list_sum(({sums})[1:k]), 'rn': list_sum(({sizes})[1:k])}})"
    cut = f"(SELECT *, list_sum({sums}) AS t, list_sum({sizes})::BIGINT AS w, {right} AS c FROM {source})"
    ok = ("list_filter(c, lambda x: x.rn >= 5 AND w - x.rn >= 5 AND w >= 10 AND abs((t - x.rs) / (w - x.rn) - x.rs / x.rn) > "
          "sqrt(0.5 * ln(4 / 0.002) * (1 / (w - x.rn) + 1 / x.rn)))")
    step = (f"SELECT feature, event_id, rn, len({ok}) > 0 AS drift, "
            f"CASE WHEN len({ok}) > 0 THEN b[1:list_max(list_transform({ok}, lambda x: x.k))] ELSE b END AS kept FROM {cut}")
    first = step.replace("@here", "(SELECT * FROM e WHERE rn = 1) e, (SELECT NULL::STRUCT(n BIGINT, s DOUBLE)[] AS kept) h")
    later = step.replace("@here", "g h JOIN e ON e.feature = h.feature AND e.rn = h.rn + 1")
    return f"g AS ({first} UNION ALL {later})"


BOTH = PH + ", " + _window_sql() + """ SELECT event_id AS id, feature, g.drift AS adwin_drift, total - low > 50 AS ph_drift
FROM h JOIN g USING (feature, event_id)"""


@query("adaptive_window", "L1", PH + ", " + _window_sql() + """ SELECT feature, event_id, drift,
  list_sum(list_transform(kept, lambda x: x.n))::BIGINT AS width FROM g""")
def _(t):
    return detectors.adaptive_window(t.events, "event_type", "ts", "event_id", "value")


@query("adaptive_window_exact", "L1")
def _(t):
    return detectors.adaptive_window(t.events, "event_type", "ts", "event_id", "value", exact_width=2000)


@query("online_detectors", "L1 L2 L3", BOTH)
def _(t):
    return drain(detectors.online_detectors(events(t), "event_type", "ts", "event_id", "value"))


@query("online_detectors_both", "L1 L3", BOTH)
def _(t):
    return drain(detectors.online_detectors(events(t), "event_type", "ts", "event_id", "value"))


@query("streaming_performance", "L4", """
WITH s AS (SELECT user_id % 3 AS m, event_type AS a, CASE WHEN value > 20 THEN event_type ELSE 'view' END AS p,
  row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 1000),
c AS (SELECT m, a AS c FROM s UNION SELECT m, p FROM s),
k AS (SELECT c.m, c.c, (SELECT count(*) FROM s WHERE s.m = c.m AND a = c.c) AS sup, (SELECT count(*) FROM s WHERE s.m = c.m AND p = c.c) AS q,
  (SELECT count(*) FROM s WHERE s.m = c.m AND a = c.c AND p = c.c) AS tp FROM c),
r AS (SELECT *, coalesce(tp / nullif(q, 0), 0) AS p, coalesce(tp / nullif(sup, 0), 0) AS r FROM k)
SELECT m::VARCHAR AS model, round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(sup * p) / sum(sup), 6) AS precision, round(sum(sup * r) / sum(sup), 6) AS recall,
  round(sum(sup * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(sup), 6) AS f1_score, sum(sup)::BIGINT AS sample_count FROM r GROUP BY m""")
def _(t):
    s = events(t).withColumn("m", F.col("user_id") % 3).withColumn("p", F.when(F.col("value") > 20, F.col("event_type")).otherwise("view"))
    out = drain(monitoring.streaming_performance(s, "m", "ts", "event_id", "event_type", "p"), "update")
    return rounded(out.drop("batch"))


DELAYED = """
SELECT p.event_id, a.truth FROM (SELECT event_id, ts FROM events WHERE event_type = 'click') p
LEFT JOIN (SELECT event_id, ts + INTERVAL 2 HOURS AS seen, value AS truth FROM events WHERE value > 10) a USING (event_id)"""


@query("delayed_ground_truth", "L5", DELAYED)
def _(t):
    predictions = t.events.where("event_type = 'click'").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    actuals = t.events.where("value > 10").select(
        "event_id", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("seen"), F.col("value").alias("truth"))
    return monitoring_join(predictions, actuals)


def monitoring_join(predictions, actuals):
    """The batch form of the stream join: the same call, as watermarks do not matter to a batch."""
    return monitoring.delayed_ground_truth(predictions, actuals, "event_id", "ts", "seen").select("event_id", "truth")


@query("delayed_ground_truth_stream", "L5", DELAYED)
def _(t):
    p = events(t).where("event_type = 'click'").select("event_id", "ts")
    a = events(t).where("value > 10").select("event_id", (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("seen"), F.col("value").alias("truth"))
    markers, close = marker_stream(t.spark)
    return drain(delayed.delayed_truth(p, a, "event_id", "ts", "seen", closing=markers), closing=close).select("event_id", "truth")


@query("stream_alert_rules", "L6 U1", """
WITH RECURSIVE c AS (SELECT ts, value, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE value > 80),
f AS (SELECT rn, ts, true AS fires, ts AS last FROM c WHERE rn = 1 UNION ALL SELECT c.rn, c.ts, c.ts >= f.last + INTERVAL 6 HOURS,
  CASE WHEN c.ts >= f.last + INTERVAL 6 HOURS THEN c.ts ELSE f.last END FROM f JOIN c ON c.rn = f.rn + 1)
SELECT 'slow' AS rule, 'warning' AS severity, epoch_us(ts) AS t FROM f WHERE fires""")
def _(t):
    rules = [al.AlertRule("slow", "value > 80", "warning", 6 * 3600), al.AlertRule("absent", "no_such_column > 1")]
    return drain(monitoring.stream_alerts(events(t), rules, "ts")).select("rule", "severity", F.unix_micros("at").alias("t"))


@query("incremental_counters", "L9", """
SELECT user_id AS model, count(*) AS requests, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS errors,
  round(sum(value), 4) AS total_latency FROM events GROUP BY user_id""")
def _(t):
    return rounded(drain(monitoring.counters(events(t), "user_id", F.col("event_type") != "error", F.col("value")), "complete"), 4)


@query("log_stream", "L8 A9", "SELECT event_type AS task_id, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    source, out, checkpoint = (tables.scratch_dir(t.spark, n) for n in ("log-in", "log-out", "log-checkpoint"))
    t.events.select(F.col("ts").cast("string").alias("timestamp"), F.lit("INFO").alias("level"), F.lit("m").alias("message"),
                    F.col("event_type").alias("task_id"), F.lit("s").alias("source")).write.json(source)
    running = monitoring.tail_logs(logs.stream_jsonl(t.spark, source), out, checkpoint)
    running.awaitTermination()
    return t.spark.read.parquet(out).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


@query("tumbling_windows", "L11", """
SELECT date_trunc('day', ts)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def _(t):
    w = monitoring.tumbling(events(t), "ts", "1 day", ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum("value")})
    out = drain(w, "complete")
    return rounded(out.select(F.col("start").cast("string").alias("day"), "event_type", "n", "total"), 4)


@query("sliding_windows", "L11", """
SELECT (d + to_hours(h::INT))::VARCHAR AS start, count(*) AS n FROM (SELECT date_trunc('day', ts) + to_hours((hour(ts) // 12 * 12)::INT) AS d, unnest([0, -12]) AS h FROM events) GROUP BY ALL""")
def _(t):
    w = monitoring.tumbling(events(t), "ts", "1 day", [], {"n": F.count(F.lit(1))}, slide="12 hours")
    return drain(w, "complete").select(F.col("start").cast("string").alias("start"), "n")


@query("session_windows", "L11", """
WITH s AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM g GROUP BY user_id, session""")
def _(t):
    out = drain(monitoring.sessions(events(t), "ts", "6 hours", ["user_id"], {"n": F.count(F.lit(1))}), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("windowed_drift", "L11 K1", """
WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-16'), x AS (SELECT min(value) AS lo, max(value) AS hi FROM ref),
r AS (SELECT greatest(0, least(9, floor((value - lo) / (hi - lo) * 10))) AS bin, count(*) AS r FROM ref, x GROUP BY 1),
c AS (SELECT date_trunc('day', ts) AS d, greatest(0, least(9, floor((value - lo) / (hi - lo) * 10))) AS bin, count(*) AS c FROM events, x WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL),
f AS (SELECT k.d, b AS bin, coalesce((SELECT r FROM r WHERE r.bin = b), 0) AS r, coalesce((SELECT c FROM c WHERE c.d = k.d AND c.bin = b), 0) AS c
  FROM (SELECT DISTINCT d FROM c) k CROSS JOIN (SELECT unnest(range(10)) AS b)),
p AS (SELECT d, (r + 1) / (sum(r) OVER (PARTITION BY d) + 10) AS p, (c + 1) / (sum(c) OVER (PARTITION BY d) + 10) AS q FROM f)
SELECT d::VARCHAR AS start, round(sum((q - p) * ln(q / p)), 6) AS psi FROM p GROUP BY d""")
def _(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    out = monitoring.windowed_drift(t.events.where(F.col("ts") >= cut), t.events.where(F.col("ts") < cut), "ts", "value", "1 day")
    return rounded(out.withColumn("start", F.col("start").cast("string")))


@query("periodic_drift_check", "L11")
def _(t):
    out, checkpoint = tables.scratch_dir(t.spark, "drift-out"), tables.scratch_dir(t.spark, "drift-checkpoint")
    cut = F.lit("2024-01-16").cast("timestamp")
    reference = t.events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    running = monitoring.periodic_drift_check(events(t).where(F.col("ts") >= cut), reference, out, checkpoint,
                                              ["psi", "js_divergence", "ks_test"], ["value", "event_type"])
    running.awaitTermination()
    return t.spark.read.parquet(out).select("column", "method", "score", "p_value", "drift_detected")
