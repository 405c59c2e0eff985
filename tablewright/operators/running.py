"""Running totals over a global order without a single-partition window.

Values are reduced to one row per distinct value, cut into ranges of about equal mass,
summed per range, and the (few) range offsets are added to a window that runs inside
each range. A heavy value costs one row, so it cannot make a range heavy.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import as_double, quoted

RANGE = "__range"


SAMPLE = 0.01


def _cuts(df: DataFrame, cols: list[str], ranges: int) -> list[list[float]]:
    """At most ``ranges`` − 1 cut points per column: quantiles of a sample, all columns in one job.

    Cut points decide how evenly the work is spread and never what the result is. Infinite ones are left out: they
    would repeat the outer border.
    """
    if ranges < 2:
        return [[] for _ in cols]
    probs = [i / ranges for i in range(1, ranges)]
    found = df.sample(SAMPLE, seed=7).approxQuantile(cols, probs, 1.0 / (2 * ranges))
    return [sorted({x for x in c if math.isfinite(x)}) for c in found]


def ranged_melt(df: DataFrame, cols: list[str], keep: list[str] | None = None,
                ranges: int | None = None) -> DataFrame:
    """(keep…, column, value, __range): numeric columns melted, each value with its range number.

    The range is found by binary search in the JVM (``Bucketizer``), cut points per column.
    """
    keep = keep or []
    ranges = ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = df.select(*[quoted(k) for k in keep], *[as_double(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    names = [f"v{i}" for i in range(len(cols))]
    splits = [[-float("inf"), *c, float("inf")] for c in _cuts(wide, names, ranges)]
    splits = [s if len(s) > 2 else [-float("inf"), 0.0, float("inf")] for s in splits]
    bucketed = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"r{i}" for i in range(len(cols))],
                          handleInvalid="keep").transform(wide)
    # one Expand over (value, range) pairs, cheaper than exploding an array per row
    pairs = bucketed.select(*keep, *[
        F.struct(F.col(f"v{i}").alias("value"), F.col(f"r{i}").cast("int").alias(RANGE)).alias(c) for i, c in enumerate(cols)])
    long = pairs.unpivot([quoted(k) for k in keep], [quoted(c) for c in cols], "column", "__pair")
    return long.select(*keep, "column", F.col("__pair.value").alias("value"), F.col(f"__pair.{RANGE}").alias(RANGE)).where(
        F.col("value").isNotNull())


def running_totals(counted: DataFrame, value: str, sums: list[str], keys: list[str],
                   descending: bool = False) -> DataFrame:
    """Adds ``cum_<s>`` for every s in sums: totals up to and including the row's value.

    ``counted`` holds one row per (keys, value) and the value's ``__range``.
    """
    def ordered(name: str):
        return F.col(name).desc() if descending else F.col(name).asc()

    per_range = counted.groupBy(*keys, RANGE).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    earlier = W.partitionBy(*keys).orderBy(ordered(RANGE)).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys, RANGE, *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__o_{s}") for s in sums])
    inside = W.partitionBy(*keys, RANGE).orderBy(ordered(value)).rowsBetween(W.unboundedPreceding, 0)
    local = counted.select("*", *[F.sum(s).over(inside).alias(f"__l_{s}") for s in sums])
    on = reduce(lambda a, b: a & b, [local[k].eqNullSafe(offsets[k]) for k in [*keys, RANGE]])
    keep = [local[c] for c in counted.columns if c != RANGE]
    return local.join(offsets, on).select(
        *keep, *[(F.col(f"__l_{s}") + F.col(f"__o_{s}")).alias(f"cum_{s}") for s in sums])
