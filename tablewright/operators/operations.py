"""Alerts, audit trails, task logs, latency and health."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import quoted
from tablewright.functions.labels import health_status
from tablewright.functions.text import chain_hash
from tablewright.operators.ordered import DAY, last_n, previous_value

# fixed values: upper bounds of the latency buckets, in seconds
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def since(df: DataFrame, time: str, as_of: Column, hours: int) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of`` (a parameter, never the wall clock)."""
    return df.where(quoted(time) > as_of - F.make_dt_interval(hours=F.lit(hours)))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(quoted(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# -- latency ------------------------------------------------------------------------

def bucket_of(seconds: Column, buckets: list[float]) -> Column:
    """Index of the first bucket whose bound is not exceeded; len(buckets) is the overflow."""
    out = None
    for i, b in enumerate(buckets):
        out = F.when(seconds <= b, i) if out is None else out.when(seconds <= b, i)
    return out.otherwise(len(buckets))


def latency_buckets(log: DataFrame, seconds: Column, by: list[str] | None = None,
                    buckets: list[float] | None = None) -> DataFrame:
    """(by…, bucket, le, n, cumulative, lo): counts per fixed bucket with running totals.

    The window runs over at most len(buckets) + 1 rows per group.
    """
    buckets = buckets or LATENCY_BUCKETS
    by = by or []
    bounds = F.array(*[F.lit(b) for b in [*buckets, float("inf")]])
    lows = F.array(*[F.lit(b) for b in [0.0, *buckets]])
    counted = log.groupBy(*by, bucket_of(seconds, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("s"))
    groups = counted.select(*by).distinct() if by else log.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(buckets)))).alias("bucket"))
    full = grid.join(counted, [*by, "bucket"], "left").fillna({"n": 0, "s": 0.0})
    running = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return full.select(*by, "bucket", bounds[F.col("bucket")].alias("le"), lows[F.col("bucket")].alias("lo"), "n", "s",
                       F.sum("n").over(running).alias("cumulative"))


def cumulative_histogram(log: DataFrame, seconds: Column, by: list[str] | None = None,
                         buckets: list[float] | None = None) -> DataFrame:
    """(by…, le, cumulative): the exposition form; le is text, "+Inf" for the overflow."""
    rows = latency_buckets(log, seconds, by, buckets)
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return rows.select(*(by or []), le.alias("le"), "cumulative")


def latency_percentiles(log: DataFrame, seconds: Column, by: list[str] | None = None,
                        buckets: list[float] | None = None) -> DataFrame:
    """(by…, count, mean_ms, p50_ms, p95_ms, p99_ms): midpoint of the first bucket that reaches the
    rank; infinite where that is the overflow bucket."""
    by = by or []
    rows = latency_buckets(log, seconds, by, buckets)
    total = F.sum("n").over(W.partitionBy(*by))
    placed = rows.withColumn("total", total)

    def at(q: float) -> Column:
        return F.min(F.when(F.col("cumulative") >= F.col("total") * q, (F.col("le") + F.col("lo")) / 2)) * 1000
    return placed.groupBy(*by).agg(
        F.max("total").alias("count"), (F.sum("s") / F.sum("n") * 1000).alias("mean_ms"),
        at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"))


def request_summary(log: DataFrame, success: Column, cache_hit: Column, by: list[str] | None = None) -> DataFrame:
    """(by…, total, success, error, success_rate, cache_hits, cache_misses, hit_rate)."""
    n = F.count(F.lit(1))
    ok, hit = F.count_if(success), F.count_if(cache_hit)
    return log.groupBy(*(by or [])).agg(
        n.alias("total"), ok.alias("success"), (n - ok).alias("error"), (ok / F.greatest(n, F.lit(1))).alias("success_rate"),
        hit.alias("cache_hits"), (n - hit).alias("cache_misses"), (hit / F.greatest(n, F.lit(1))).alias("hit_rate"))


def last_n_latency(log: DataFrame, model: str, order: list[Column], latency: Column, n: int = 1000) -> DataFrame:
    """(model, n, mean_latency) over the newest n calls per model."""
    return (last_n(log, [model], order, n).groupBy(quoted(model).alias("model"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean_latency")))


# -- alerts: (rule, severity, status, fired_at) ----------------------------------------------

def alert_statistics(alerts: DataFrame, as_of: Column) -> DataFrame:
    """(dimension, value, n): total, active, last_24h, and counts by severity and rule."""
    recent = F.col("fired_at") > as_of - F.expr("INTERVAL 24 HOURS")
    facets = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("rule").alias("dimension"), F.col("rule").alias("value")),
        F.when(F.col("status") == "firing", F.struct(F.lit("active").alias("dimension"), F.lit("all").alias("value"))),
        F.when(recent, F.struct(F.lit("last_24h").alias("dimension"), F.lit("all").alias("value"))))
    return (alerts.select(F.inline(F.filter(facets, lambda x: x.isNotNull())))
            .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")))


def active_alerts(alerts: DataFrame, severity: str | None = None) -> DataFrame:
    rows = alerts.where(F.col("status") == "firing")
    if severity:
        rows = rows.where(F.col("severity") == severity)
    return rows.orderBy(F.col("fired_at").desc(), "rule")


def alert_states(log: DataFrame) -> DataFrame:
    """(alert_id, state, since, n_events): what the last entry of a log (alert_id, kind, at) says about each alert.

    ``kind`` is fired, acknowledged, silenced or resolved; of entries at one time the largest kind by name counts.
    """
    last = F.max(F.struct("at", "kind"))
    return log.groupBy("alert_id").agg(last.alias("l"), F.count(F.lit(1)).alias("n_events")).select(
        "alert_id", F.col("l.kind").alias("state"), F.col("l.at").alias("since"), "n_events")


def alert_history(alerts: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` alerts (TakeOrdered)."""
    return alerts.orderBy(F.col("fired_at").desc(), "rule").limit(limit)


def health_overview(alerts: DataFrame, degraded: Column, drift_rate: Column) -> DataFrame:
    """One row (active_alerts, critical, health_score, status)."""
    firing = F.col("status") == "firing"
    one = alerts.agg(F.count_if(firing).alias("active_alerts"), F.count_if(firing & (F.col("severity") == "critical")).alias("critical"))
    score = (F.lit(100.0)
             - F.when(F.col("critical") > 0, 30.0 * F.col("critical")).otherwise(10.0 * F.col("active_alerts"))
             - F.when(degraded, 20.0).otherwise(0.0) - F.when(drift_rate > 0.5, 15.0).otherwise(0.0))
    base = F.when(F.col("critical") > 0, "critical").when(F.col("active_alerts") > 0, "warning").otherwise("healthy")
    return (one.withColumn("health_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
            .withColumn("status", health_status(F.col("health_score"), base)))


def metric_timeline(snapshots: DataFrame, metric: str, as_of: Column, hours: int = 24) -> DataFrame:
    """(at, value) of one metric in the last ``hours``; ``snapshots`` is (metric, at, value)."""
    return since(snapshots, "at", as_of, hours).where((F.col("metric") == metric) & F.col("value").isNotNull()).select("at", "value")


def alert_timeline(alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(severity, n) over the last ``hours``."""
    return since(alerts, "fired_at", as_of, hours).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def monitoring_recommendations(report: DataFrame) -> DataFrame:
    """(recommendation) rows from one row (degraded, drift_rate, last_24h)."""
    items = F.array(
        F.when(F.col("degraded"), F.lit("Metrics are below the baseline: train again.")),
        F.when(F.col("drift_rate") > 0.3, F.lit("Drift in many checks: compare the inputs with the training data.")),
        F.when(F.col("last_24h") > 10, F.lit("Alerts are frequent: set the limits anew.")))
    return report.select(F.explode(F.array_compact(items)).alias("recommendation"))


def monitoring_report(alerts: DataFrame, as_of: Column, degraded: Column, drift_rate: Column) -> DataFrame:
    """One row: health, alert volume and the recommendations that apply."""
    recent = F.col("fired_at") > as_of - F.expr("INTERVAL 24 HOURS")
    volume = alerts.agg(F.count(F.lit(1)).alias("total_alerts"), F.count_if(recent).alias("last_24h"))
    one = health_overview(alerts, degraded, drift_rate).crossJoin(F.broadcast(volume)).withColumn(
        "degraded", degraded).withColumn("drift_rate", drift_rate)
    found = monitoring_recommendations(one).agg(F.array_sort(F.collect_list("recommendation")).alias("recommendations"))
    return one.crossJoin(F.broadcast(found))


# -- drift history: (check_id, at, drift_detected, score, columns) ---------------------------

def drift_history_report(history: DataFrame, last: int = 10) -> DataFrame:
    """One row (total_checks, recent_checks, drift_rate) over the newest ``last`` checks."""
    total = history.agg(F.count(F.lit(1)).alias("total_checks"))
    recent = history.orderBy(F.col("at").desc(), F.col("check_id").desc()).limit(last)
    return recent.agg(F.count(F.lit(1)).alias("recent_checks"), F.coalesce(F.avg(F.col("drift_detected").cast("double")), F.lit(0.0))
                      .alias("drift_rate")).crossJoin(F.broadcast(total))


def most_drifted_columns(history: DataFrame, last: int = 10, k: int = 10) -> DataFrame:
    """(column, n): how often a column drifted in the newest ``last`` checks."""
    recent = history.orderBy(F.col("at").desc(), F.col("check_id").desc()).limit(last)
    return (recent.select(F.explode("columns").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "column").limit(k))


def drift_timeline(history: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return since(history, "at", as_of, hours).select("check_id", "at", "drift_detected", "score",
                                                    F.size("columns").alias("drifted_columns"))


# -- audit and logs ---------------------------------------------------------------------

def audit_query(events: DataFrame, start=None, end=None, action: str | None = None, user=None, severity: str | None = None,
                limit: int = 100) -> DataFrame:
    """Conjunctive filter; newest day first and in time order within the day; at most ``limit`` rows."""
    for name, value in (("action", action), ("user_id", user), ("severity", severity)):
        if value is not None:
            events = events.where(F.col(name) == value)
    if start is not None:
        events = events.where(F.col("timestamp") >= start)
    if end is not None:
        events = events.where(F.col("timestamp") <= end)
    return events.orderBy(F.col("timestamp").cast("date").desc(), F.col("timestamp").asc(), "event_id").limit(limit)


def log_tail(logs: DataFrame, task: str, order: list[Column], n: int = 100) -> DataFrame:
    """The newest n lines per task."""
    return last_n(logs, [task], order, n)


def chain_write(events: DataFrame, chain: list[str], time: str, event_id: str, stamp: Column) -> DataFrame:
    """Adds ``chain_hash``: every event hashed with its predecessor's hash, "genesis" first.

    The chain of one source is sequential by definition; sources run in parallel. Each task
    streams its sorted rows and keeps one hash, whatever the length of a chain.
    """
    prepared = events.withColumn("__stamp", stamp.cast("string")).withColumn("__id", quoted(event_id).cast("string"))
    ordered = prepared.repartition(*chain).sortWithinPartitions(*chain, time, event_id)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", chain_hash string"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, previous = None, "genesis"
        for batch in batches:
            hashes = []
            for key, eid, ts in zip(zip(*[batch[c] for c in chain]), batch["__id"], batch["__stamp"]):
                if key != source:
                    source, previous = key, "genesis"
                previous = hashlib.sha256(f"{previous}:{eid}:{ts}".encode()).hexdigest()[:32]
                hashes.append(previous)
            yield batch.drop(columns=["__stamp", "__id"]).assign(chain_hash=hashes)

    return ordered.mapInPandas(walk, schema)


def chain_verify(events: DataFrame, chain: list[str], time: str, event_id: str, stamp: Column,
                 seconds: int = DAY) -> DataFrame:
    """Events whose stored hash does not follow from the stored hash before it.

    Because the predecessor is read from storage and not recomputed, the check is parallel.
    Events without a hash are passed over.
    """
    hashed = events.where(F.col("chain_hash").isNotNull())
    linked = previous_value(hashed, chain, time, [event_id], "chain_hash", "__previous", seconds)
    expected = chain_hash(F.coalesce("__previous", F.lit("genesis")), quoted(event_id).cast("string"), stamp.cast("string"))
    return linked.where(F.col("chain_hash") != expected).drop("__previous")


def task_durations(tasks: DataFrame, kind: str, started: str, completed: str) -> DataFrame:
    """(type, n, finished, mean_seconds, max_seconds)."""
    seconds = (F.unix_micros(quoted(completed).cast("timestamp")) - F.unix_micros(quoted(started).cast("timestamp"))) / 1e6
    return tasks.groupBy(quoted(kind).alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.count(seconds).alias("finished"), F.avg(seconds).alias("mean_seconds"),
        F.max(seconds).alias("max_seconds"))


def task_list(tasks: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Newest tasks first."""
    rows = tasks if kind is None else tasks.where(F.col("type") == kind)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
