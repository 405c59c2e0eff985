"""Moments of all pairs of columns in one scan.

For every pair the rows count where both values are present, so n, both means, both sums of squares and the sum of products
differ from pair to pair. A batch gives all of them at once as products of its value and mask matrices. They are centred at a
value of the column itself, so a constant column has exactly no spread, and parts are merged by the update of means and
centred sums, which loses nothing to large means. Tasks return one row a pair; those rows are folded in two rounds, so that
no fold grows with the number of tasks alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double

#: rows that are multiplied at once, and groups of the first round of folding
ROWS, SALTS = 16_384, 64
#: beside squares this small, a spread is rounding
ROUNDING = 1e-13
PARTS = "n double, mx double, my double, sx double, sy double, sxy double"


def _moments(x: np.ndarray) -> np.ndarray:
    """(6, columns, columns): n, mean and centred squares of the first, then of the second, and products; NaN is missing."""
    present = ~np.isnan(x)
    finite = np.isfinite(x)
    endless = present & ~finite
    values = np.where(finite, x, 0.0)
    count = np.maximum(finite.sum(0), 1)
    middle = values.sum(0) / count
    # the value nearest to the mean, so that equal values become exactly zero
    nearest = np.abs(np.where(finite, x - middle, np.inf)).argmin(0)
    shift = np.where(finite.any(0), values[nearest, np.arange(x.shape[1])], 0.0)
    mask = finite.astype(float)
    c = np.where(finite, x - shift, 0.0)
    n = mask.T @ mask
    first, square, both = c.T @ mask, (c * c).T @ mask, c.T @ c
    least = np.maximum(n, 1)
    mean = first / least
    spread = square - first * mean
    spread = np.where(spread <= ROUNDING * square, 0.0, spread)
    product = both - first * first.T / least
    mx = mean + shift[:, None]
    if endless.any():  # a pair that meets an infinite value has no moments
        e, p = endless.astype(float), present.astype(float)
        met = (e.T @ p + p.T @ e) > 0
        product, n = np.where(met, np.nan, product), p.T @ p
    return np.stack([n, mx, mx.T, spread, spread.T, product])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = a[0] * b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    dx, dy = (np.where((a[0] > 0) & (b[0] > 0), d, 0.0) for d in (dx, dy))
    w = b[0] / np.maximum(n, 1)
    mx, my = (np.where(a[0] > 0, p + d * w, q) for p, q, d in ((a[1], b[1], dx), (a[2], b[2], dy)))
    return np.stack([n, mx, my, a[3] + b[3] + dx * dx * share, a[4] + b[4] + dy * dy * share, a[5] + b[5] + dx * dy * share])


def _folded(parts: Column) -> Column:
    """The same merge over an array of structs."""
    def step(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share, w = a["n"] * b["n"] / n, b["n"] / n
        dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
        return F.struct(n.alias("n"), (a["mx"] + dx * w).alias("mx"), (a["my"] + dy * w).alias("my"),
                        (a["sx"] + b["sx"] + dx * dx * share).alias("sx"), (a["sy"] + b["sy"] + dy * dy * share).alias("sy"),
                        (a["sxy"] + b["sxy"] + dx * dy * share).alias("sxy"))
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), step)


def pair_moments(df: DataFrame, cols: list[str], others: list[str] | None = None) -> DataFrame:
    """(i, j, n, mx, my, sx, sy, sxy) for i < j of ``cols``, by position; with ``others`` for i of ``cols`` and j of ``others``.

    Pairs without a common row are left out. ``sxy`` is NaN for a pair that meets an infinite value.
    """
    every = [*cols, *(others or [])]
    half = len(cols)

    def run(batches):
        total = None
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(every))], axis=1).astype(float)
            for at in range(0, len(x), ROWS):
                part = _moments(x[at:at + ROWS])
                total = part if total is None else _merged(total, part)
        if total is not None:
            size = len(every)
            wanted = np.triu(np.ones((size, size), bool), 1)
            if others is not None:
                wanted[half:] = wanted[:, :half] = False
            i, j = np.nonzero(wanted & (total[0] > 0))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j - (half if others is not None else 0), pa.int32()),
                                              *[pa.array(m[i, j]) for m in total]], ["i", "j", "n", "mx", "my", "sx", "sy", "sxy"])

    wide = df.select(*[as_double(df, c).alias(f"v{k}") for k, c in enumerate(every)])
    parts = wide.mapInArrow(run, f"i int, j int, {PARTS}").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    row = F.struct("n", "mx", "my", "sx", "sy", "sxy")
    some = parts.groupBy("i", "j", "salt").agg(_folded(F.collect_list(row)).alias("m")).select("i", "j", "m.*")
    return some.groupBy("i", "j").agg(_folded(F.collect_list(row)).alias("m")).select("i", "j", "m.*")


def correlation(moments: DataFrame) -> Column:
    """Pearson's r; null where a side has no spread or the pair meets an infinite value."""
    r = F.try_divide(F.col("sxy"), F.sqrt("sx") * F.sqrt("sy"))
    return F.when((F.col("sx") > 0) & (F.col("sy") > 0) & ~F.isnan("sxy"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
