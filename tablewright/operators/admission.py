"""Admission control over request logs: sliding-window limits and alert cooldowns.

Whether a request is admitted depends on which earlier ones were, so the decision is a
fold in time order. What can be taken out of the fold is: equal timestamps are
counted before the shuffle; a key's history falls apart wherever a whole window is empty;
and a stretch that never exceeds the limit is admitted without any fold. What remains
is folded as a sorted stream of (key, time, count) rows with at most ``limit`` entries
of state; one uninterrupted busy stretch of one key is sequential by definition.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import quoted
from tablewright.operators.ordered import micros


def admit(requests: DataFrame, key: str, time: str, limit: Column, window_seconds: Column) -> DataFrame:
    """(key, t, requests, accepted): how many of the requests at each instant were admitted.

    A request is admitted iff fewer than ``limit`` admitted ones lie in the window before it;
    refused ones do not count. ``t`` is in microseconds; limit and window may differ per key.
    """
    counted = (requests.select(quoted(key).alias("key"), micros(requests, time).alias("t"),
                               limit.cast("bigint").alias("limit"),
                               (window_seconds.cast("bigint") * 1_000_000).alias("span"))
               .groupBy("key", "t", "limit", "span").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("b", F.floor(F.col("t") / F.col("span")).cast("bigint")))
    by_key = W.partitionBy("key").orderBy("b")  # one row per key and non-empty window
    per_bucket = counted.groupBy("key", "b", "limit").agg(F.sum("n").alias("bn"))
    before = F.lag("b").over(by_key)
    linked = per_bucket.select(
        "key", "b", "limit", "bn",
        F.when(F.col("b") - before == 1, F.lag("bn").over(by_key)).otherwise(0).alias("bp"),
        F.when(before.isNull() | (F.col("b") - before > 1), 1).otherwise(0).alias("starts"))
    numbered = linked.withColumn("segment", F.sum("starts").over(by_key.rowsBetween(W.unboundedPreceding, 0)))
    calm = F.max(F.col("bn") + F.col("bp")).over(W.partitionBy("key", "segment")) <= F.col("limit")
    segments = numbered.select("key", "b", "segment", calm.alias("calm"))
    placed = counted.join(segments.withColumnRenamed("key", "k2").withColumnRenamed("b", "b2"),
                          F.col("key").eqNullSafe(F.col("k2")) & (F.col("b") == F.col("b2"))).drop("k2", "b2")
    free = placed.where("calm").select("key", "t", F.col("n").alias("requests"), F.col("n").alias("accepted"))
    busy = (placed.where(~F.col("calm")).select("key", "segment", "t", "n", "limit", "span")
            .repartition("key", "segment").sortWithinPartitions("key", "segment", "t"))
    key_type = requests.schema[key].dataType.simpleString()
    folded = busy.mapInPandas(_fold, f"key {key_type}, t bigint, requests bigint, accepted bigint")
    return free.unionByName(folded)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, window, held = None, deque(), 0
    for batch in batches:
        out = []
        for key, segment, t, n, limit, span in batch.itertuples(index=False):
            if (key, segment) != current:
                current, window, held = (key, segment), deque(), 0
            while window and window[0][0] <= t - span:
                held -= window.popleft()[1]
            taken = max(0, min(n, limit - held))
            if taken:
                window.append((t, taken))
                held += taken
            out.append(taken)
        yield pd.DataFrame({"key": batch["key"], "t": batch["t"], "requests": batch["n"], "accepted": out})


def sliding_window_limit(log: DataFrame, key: str, time: str, limit: int = 100, window_seconds: int = 60) -> DataFrame:
    """(key, t, requests, accepted) with one limit for all keys."""
    return admit(log, key, time, F.lit(limit), F.lit(window_seconds))


def limit_of(key: Column, path: Column, key_limits: dict[str, tuple[int, int]], route_limits: dict[str, tuple[int, int]],
             default: tuple[int, int] = (100, 60)) -> Column:
    """struct(limit, window): the key's own limit, else that of the first route prefix, else the default."""
    def pair(v: tuple[int, int]) -> Column:
        return F.struct(F.lit(v[0]).alias("limit"), F.lit(v[1]).alias("window"))

    out = None
    for k, v in key_limits.items():
        out = F.when(key == k, pair(v)) if out is None else out.when(key == k, pair(v))
    for route, v in route_limits.items():
        out = F.when(path.startswith(route), pair(v)) if out is None else out.when(path.startswith(route), pair(v))
    return pair(default) if out is None else out.otherwise(pair(default))


def raw_window_counts(log: DataFrame, key: str, time: str, window_seconds: int) -> DataFrame:
    """Requests of the key in the last ``window_seconds`` up to each request, refused or not.

    The rows before a bucket that a frame can reach are copied into it, so the range frame
    never leaves (key, bucket).
    """
    span = window_seconds * 1_000_000
    base = log.withColumn("__t", micros(log, time)).withColumn("__own", F.floor(F.col("__t") / span))
    copies = base.withColumn("__b", F.explode(F.array("__own", F.col("__own") + 1)))
    frame = W.partitionBy(key, "__b").orderBy("__t").rangeBetween(-span + 1, 0)
    return (copies.withColumn("window_count", F.count(F.lit(1)).over(frame)).where("__b = __own")
            .select(*log.columns, "window_count"))


def fire_with_cooldown(candidates: DataFrame, rule: str, time: str, cooldown_seconds: Column) -> DataFrame:
    """(rule, t) of the candidates that fire: none within the cooldown after the last firing.

    The same fold with a limit of one.
    """
    return (admit(candidates, rule, time, F.lit(1), cooldown_seconds)
            .where("accepted > 0").select(F.col("key").alias("rule"), "t"))
