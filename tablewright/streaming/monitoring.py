"""Streaming performance, delayed ground truth, counters, windows and periodic drift checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tablewright.functions.columns import quoted
from tablewright.operators.drift import DriftReference

PERFORMANCE = "model string, accuracy double, precision double, recall double, f1_score double, sample_count bigint"


def window_metrics(actual: pd.Series, pred: pd.Series) -> tuple[float, float, float, float]:
    """Accuracy and support-weighted precision, recall and F1 of one bounded window."""
    counts = pd.crosstab(actual, pred)
    support, predicted = counts.sum(axis=1), counts.sum(axis=0)
    accuracy = precision = recall = f1 = 0.0
    total = support.sum()
    for c in support.index:
        tp = counts.at[c, c] if c in counts.columns else 0
        p = tp / predicted[c] if c in counts.columns and predicted[c] else 0.0
        r = tp / support[c]
        w = support[c] / total
        accuracy += tp / total
        precision += w * p
        recall += w * r
        f1 += w * (2 * p * r / (p + r) if p + r else 0.0)
    return float(accuracy), float(precision), float(recall), float(f1)


def streaming_performance(stream: DataFrame, model: str, time: str, tie: str, actual: str, pred: str,
                          window: int = 1000, minimum: int = 10) -> DataFrame:
    """Metrics over the last ``window`` labelled rows per model, after every micro-batch.

    State is bounded by the window. Fewer than ``minimum`` rows give no output.
    """
    rows = stream.where(quoted(actual).isNotNull()).select(
        quoted(model).cast("string").alias("model"), quoted(time).alias("t"), quoted(tie).cast("bigint").alias("id"),
        quoted(actual).cast("string").alias("a"), quoted(pred).cast("string").alias("p"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = None
        for part in batches:  # keeps no more than a window while reading the group
            newest = part if newest is None else pd.concat([newest, part])
            newest = newest.sort_values(["t", "id"]).tail(window)
        old_a, old_p = state.get if state.exists else ([], [])
        a = (list(old_a) + newest["a"].tolist())[-window:]
        p = (list(old_p) + newest["p"].tolist())[-window:]
        state.update((a, p))
        if len(a) >= minimum:
            yield pd.DataFrame([(key[0], *window_metrics(pd.Series(a), pd.Series(p)), len(a))],
                               columns=["model", "accuracy", "precision", "recall", "f1_score", "sample_count"])

    return rows.groupBy("model").applyInPandasWithState(
        step, PERFORMANCE, "actual array<string>, pred array<string>", "update", "NoTimeout")


def delayed_ground_truth(predictions: DataFrame, actuals: DataFrame, key: str, prediction_time: str, actual_time: str,
                         max_delay: str = "1 day", lateness: str = "10 minutes") -> DataFrame:
    """Predictions joined with the truth that arrives within ``max_delay``; else with null.

    Both sides carry a watermark, so state is dropped once no partner can come any more.
    """
    p = predictions.withWatermark(prediction_time, lateness).alias("p")
    a = actuals.withWatermark(actual_time, lateness).alias("a")
    on = F.expr(f"p.`{key}` = a.`{key}` AND a.`{actual_time}` >= p.`{prediction_time}` "
                f"AND a.`{actual_time}` <= p.`{prediction_time}` + INTERVAL {max_delay}")
    rest = [F.col(f"a.`{c}`") for c in actuals.columns if c != key and c not in predictions.columns]
    return p.join(a, on, "leftOuter").select("p.*", *rest)


def counters(stream: DataFrame, model: str, success: Column, latency: Column) -> DataFrame:
    """(model, requests, success, errors, total_latency): running totals, for update or complete mode."""
    return stream.groupBy(quoted(model).alias("model")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(success).alias("success"), F.count_if(~success).alias("errors"),
        F.sum(latency).alias("total_latency"))


def tumbling(stream: DataFrame, time: str, width: str, by: list[str], stats: dict[str, Column], lateness: str = "1 hour",
             slide: str | None = None) -> DataFrame:
    """(start, end, by…, stats…) per tumbling or sliding window; rows later than the watermark are dropped."""
    w = F.window(quoted(time), width, slide) if slide else F.window(quoted(time), width)
    return (stream.withWatermark(time, lateness).groupBy(w.alias("w"), *by)
            .agg(*[c.alias(n) for n, c in stats.items()])
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *stats))


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], stats: dict[str, Column], lateness: str = "1 hour") -> DataFrame:
    """(start, end, by…, stats…) per session: rows of a key no further apart than ``gap``."""
    return (stream.withWatermark(time, lateness).groupBy(F.session_window(quoted(time), gap).alias("w"), *by)
            .agg(*[c.alias(n) for n, c in stats.items()])
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *stats))


def periodic_drift_check(stream: DataFrame, reference: DataFrame | DriftReference, out: str, checkpoint: str, methods: list[str] | None = None,
                         columns: list[str] | None = None, interval: str | None = None,
                         on_report: Callable[[DataFrame, int], None] | None = None):
    """Starts a query that writes a drift report of every micro-batch against a fixed reference to ``out``.

    The reference is read once, into value counts below ``out``; a micro-batch is compared with those. A ``DriftReference``
    stored before is used as it is. ``interval`` is the processing-time trigger; without it all available input is checked once.
    """
    kept = reference if isinstance(reference, DriftReference) else DriftReference.store(reference, f"{out}_reference", columns)

    def check(batch: DataFrame, i: int) -> None:
        wanted = batch.select(*[c for c in batch.columns if columns is None or c in columns])
        if wanted.isEmpty():
            return
        report = kept.detect(wanted, methods).withColumn("batch", F.lit(i))
        report.write.mode("overwrite").parquet(f"{out}/check={i}")
        if on_report:
            on_report(report, i)

    writer = stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_drift(events: DataFrame, reference: DataFrame, time: str, value: str, width: str, bins: int = 10) -> DataFrame:
    """(start, psi) per time window of a batch or stream-shaped history against a reference.

    Bin edges come from the reference (one row, broadcast); values outside fall into the outer bins.
    """
    edges = reference.agg(F.min(quoted(value)).alias("lo"), F.max(quoted(value)).alias("hi"))
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(
        F.coalesce(F.try_divide(quoted(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins)))
    ref = reference.crossJoin(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("r"))
    cur = (events.crossJoin(F.broadcast(edges)).groupBy(F.window(quoted(time), width)["start"].alias("start"), place.alias("bin"))
           .agg(F.count(F.lit(1)).alias("c")))
    grid = cur.select("start").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    full = (grid.join(F.broadcast(ref), "bin", "left").join(cur, ["start", "bin"], "left").fillna({"r": 0, "c": 0}))
    totals = full.groupBy("start").agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"))
    p, q = (F.col("r") + 1) / (F.col("rt") + bins), (F.col("c") + 1) / (F.col("ct") + bins)
    return full.join(totals, "start").groupBy("start").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def tail_logs(stream: DataFrame, out: str, checkpoint: str, partition_by: str = "task_id"):
    """Starts a query that appends arriving log lines to parquet, partitioned by task for later tails."""
    return (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .partitionBy(partition_by).trigger(availableNow=True).start())


def stream_alerts(stream: DataFrame, rules, time: str) -> DataFrame:
    """(rule, severity, at) of rules whose condition holds, with the cooldown kept in state per rule.

    State is one time per rule. Rows of one micro-batch are taken in time order.
    """
    from tablewright.streaming.alerts import candidates
    found = candidates(stream, rules).select("rule", "severity", "cooldown", quoted(time).alias("at"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        new = pd.concat(list(batches)).sort_values("at")  # one row per metrics snapshot and rule
        fired = []
        for severity, cooldown, at in zip(new["severity"], new["cooldown"], new["at"]):
            now = at.value // 1000
            if last is None or now - last >= cooldown * 1_000_000:
                last = now
                fired.append((key[0], severity, at))
        state.update((last,))
        yield pd.DataFrame(fired, columns=["rule", "severity", "at"])

    return found.groupBy("rule").applyInPandasWithState(
        step, "rule string, severity string, at timestamp", "last bigint", "append", "NoTimeout")
