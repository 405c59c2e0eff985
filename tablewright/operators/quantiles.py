"""Exact linear-interpolated quantiles without holding a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in the memory of one
reducer, and a sketch per task is costly to build and to merge. Here a sample gives
a few hundred equal-depth ranges per column; a first scan counts the rows of each
range exactly, which tells the ranges that hold the wanted ranks; a second scan counts
the distinct values of those ranges only. Both scans combine on the map side, the
ranges are found inside generated code, and the sample cannot affect the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.operators.running import RANGE, ranged_melt, running_totals

RANGES = 256
SPLITS = 256
INF = float("inf")


def exact_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float], by: list[str] | None = None,
                    ranges: int = RANGES) -> DataFrame:
    """(by…, column, n, <one column per entry of probs>), NaN and null skipped.

    ``probs`` maps output names to probabilities. Columns without a value give no row. Infinities are values like
    others, at the ends of the order.
    """
    by = by or []
    keys = [*by, "column"]
    long = ranged_melt(df, cols, by, ranges)
    finite = F.when(F.abs("value") < INF, F.col("value"))
    counted = long.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("m"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    whole = W.partitionBy(*keys)  # at most `ranges` rows
    placed = counted.select(
        *keys, RANGE, "m", "lo", "hi", F.sum("m").over(whole).alias("n"),
        F.coalesce(F.sum("m").over(whole.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def ranks(p: float):
        position = F.lit(p) * (F.col("n") - 1)
        low = F.floor(position)
        return low, F.least(low + 1, F.col("n") - 1), position - low

    def holds(rank):
        return (rank >= F.col("before")) & (rank < F.col("before") + F.col("m"))

    wanted = reduce(lambda a, b: a | b, [holds(r) for p in probs.values() for r in ranks(p)[:2]])
    targets = placed.where(wanted).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(RANGE).alias("__kr"),
                                          "lo", "hi", "n", "before")
    if not by:
        targets = F.broadcast(targets)  # two rows per column and probability
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) if k in by else F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    near = long.join(targets, [*on, F.col(RANGE) == F.col("__kr")])
    # equal-width pieces of a range, infinities apart: the window below runs inside one piece
    piece = F.when(F.col("value") == INF, SPLITS).when(F.col("value") == -INF, -1).when(
        F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SPLITS),
                                                     F.lit(SPLITS - 1))).otherwise(0)
    values = (near.groupBy(*keys, F.col("__kr").alias("__in"), "n", "before", "value", piece.alias(RANGE))
              .agg(F.count(F.lit(1)).alias("c")))
    exact = running_totals(values, "value", ["c"], [*keys, "__in"])
    last = F.col("before") + F.col("cum_c")

    def value_at(rank):
        return F.max(F.when((rank >= last - F.col("c")) & (rank < last), F.col("value")))

    def quantile(p: float):
        low, high, fraction = ranks(p)
        a, b = value_at(low), value_at(high)
        f = F.max(fraction)
        # between -inf and a number lies -inf; between -inf and inf there is no value
        return (F.when((a == b) | (f == 0) | ((a == -INF) & (b < INF)), a).when(a == -INF, F.lit(float("nan")))
                .otherwise(a + (b - a) * f))

    return exact.groupBy(*keys).agg(F.max("n").alias("n"), *[quantile(p).alias(name) for name, p in probs.items()])
