"""Imputation, encoding and scaling: statistics are fitted first, then applied as pure projections.

Fitted values are one per column (fills, means) and travel as literals; mappings of
categories to codes stay DataFrames and are joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablewright.functions.columns import (CATEGORICAL, NUMERIC, as_double, categorical_columns, is_missing, kind_of,
                                           numeric_columns, quoted, stats_rows)
from tablewright.functions.lineage import cut_lineage
from tablewright.functions.text import clip, finite, lowercase_strings
from tablewright.operators.categories import value_counts
from tablewright.operators.quantiles import exact_quantiles

#: a mapping of at most so many labels and bytes travels to the rows
SHIPPED_LABELS, SHIPPED_BYTES = 100_000, 16_000_000


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def _numeric_fill(df: DataFrame, cols: list[str], strategy: str) -> dict[str, float]:
    """One number per column; empty columns have none."""
    if strategy == "median":
        rows = exact_quantiles(df, cols, {"fill": 0.5}).select("column", "fill")
    else:
        rows = stats_rows(df, cols, lambda d, c: [F.avg(as_double(d, c)).alias("fill")])
    return {r["column"]: r["fill"] for r in rows.collect() if r["fill"] is not None}


def fit_fill_values(df: DataFrame, cols: list[str], strategy: str = "mean") -> dict[str, object]:
    """Fill value per column: ``mean`` or ``median`` of numbers, ``most_frequent`` of anything
    (smallest on a tie). Read by one job; its size is the number of columns."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    if strategy in ("mean", "median"):
        return _numeric_fill(df, [c for c in cols if kind_of(df.schema[c].dataType) == NUMERIC], strategy)
    if strategy != "most_frequent":
        raise ValueError(f"unknown strategy {strategy}")
    parts = None
    for c in cols:  # keeps each column's own order for ties, one row each, one job for all
        one = value_counts(df, c, 1).select(F.lit(c).alias("column"), F.col("value").cast("string").alias("text"))
        parts = one if parts is None else parts.unionByName(one)
    found = {r["column"]: r["text"] for r in parts.collect()}
    return {c: (v if kind_of(df.schema[c].dataType) == CATEGORICAL else F.lit(v).cast(df.schema[c].dataType))
            for c, v in found.items()}


def fill_missing(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Missing values replaced; integer columns become double when the fill is fractional."""
    def one(c: str) -> Column:
        if c not in fills:
            return quoted(c)
        v = fills[c]
        value = v if isinstance(v, Column) else F.lit(v)
        return F.when(is_missing(df, c), value).otherwise(quoted(c)).alias(c)
    return df.select(*[one(c) for c in df.columns])


def impute(df: DataFrame, cols: list[str], strategy: str = "mean") -> DataFrame:
    return fill_missing(df, fit_fill_values(df, cols, strategy))


def fill_na_median(df: DataFrame) -> DataFrame:
    return impute(df, numeric_columns(df), "median")


def fill_na_mode(df: DataFrame) -> DataFrame:
    return impute(df, categorical_columns(df), "most_frequent")


def fill_median_then_zero(df: DataFrame) -> DataFrame:
    """Numbers by their median, and 0 where a column has none."""
    cols = numeric_columns(df)
    medians = _numeric_fill(df, cols, "median")
    return fill_missing(df, {c: medians.get(c, 0.0) for c in cols})


def one_hot(df: DataFrame, col: str, categories: list | None = None) -> DataFrame:
    """Column replaced by ``col_value`` indicator columns in value order; null gives all zeros.

    The categories become column names, so they are read to the driver; give them to avoid the job.
    """
    if categories is None:
        found = df.where(~is_missing(df, col)).select(quoted(col).alias("v")).distinct().orderBy("v")
        categories = [r["v"] for r in found.collect()]
    indicators = [F.coalesce((quoted(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in categories]
    return df.select(*[quoted(c) for c in df.columns if c != col], *indicators)


def label_mapping(df: DataFrame, col: str, null_token: str = "nan") -> DataFrame:
    """(label, code): rank of the string in sorted order; missing values become ``null_token``.

    Tokens in use: "nan", "NaN", "Unknown", "_MISSING_". The distinct labels are range-sorted
    over the cluster and numbered per partition; the partition sizes (one row each) give the
    offsets. The sorted table is checkpointed, because both uses must see the same partitions.

    A mapping of few labels carries a broadcast hint: joined by a shuffle, rows would gather in as many
    tasks as there are labels. AQE does not choose it, as few labels leave most shuffle partitions empty.
    """
    text = F.when(is_missing(df, col), F.lit(null_token)).otherwise(quoted(col).cast("string"))
    labels = df.select(text.alias("label")).distinct().orderBy("label")
    placed = cut_lineage(labels.withColumn("__id", F.monotonically_increasing_id())).select(
        "label", F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__pos"))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    mapping = placed.join(F.broadcast(offsets), "__part").select(
        "label", (F.col("__o") + F.col("__pos")).cast("int").alias("code"))
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("label")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(mapping) if size["n"] <= SHIPPED_LABELS and size["bytes"] <= SHIPPED_BYTES else mapping


def label_encode(df: DataFrame, col: str, null_token: str = "nan", mapping: DataFrame | None = None,
                 unseen: str = "minus_one") -> DataFrame:
    """Column replaced by its label code.

    For values the mapping lacks: ``minus_one``, or ``missing_or_first`` (the code of
    "_MISSING_" if it is a label, else 0). The rule is applied per row.
    """
    mapping = label_mapping(df, col, null_token) if mapping is None else mapping
    text = F.when(is_missing(df, col), F.lit(null_token)).otherwise(quoted(col).cast("string"))
    # no hint here: a small mapping brings one, a large one is joined by a shuffle
    joined = df.withColumn("label", text).join(mapping, "label", "left")
    if unseen == "minus_one":
        code = F.coalesce("code", F.lit(-1))
    elif unseen == "missing_or_first":
        known = mapping.agg(F.coalesce(F.max(F.when(F.col("label") == "_MISSING_", F.col("code"))), F.lit(0)).alias("__m"))
        joined = joined.crossJoin(F.broadcast(known))  # one row
        code = F.coalesce("code", "__m")
    else:
        raise ValueError(f"unknown policy {unseen}")
    return joined.select(*[(code.alias(c) if c == col else quoted(c)) for c in df.columns])


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, dict[str, float]]:
    """Mean, population deviation, min and max per column from one aggregate."""
    rows = stats_rows(df, cols, lambda d, c: [
        F.avg(as_double(d, c)).alias("mean"), F.stddev_pop(as_double(d, c)).alias("std"),
        F.min(as_double(d, c)).alias("min"), F.max(as_double(d, c)).alias("max")])
    return {r["column"]: r.asDict() for r in rows.collect()}


def apply_scaler(df: DataFrame, fitted: dict[str, dict[str, float]], method: str = "standard") -> DataFrame:
    def one(c: str) -> Column:
        f = fitted.get(c)
        if f is None or f["mean"] is None:
            return quoted(c)
        v = as_double(df, c)
        if method == "standard":
            return ((v - f["mean"]) / (f["std"] or 1.0)).alias(c)
        width = (f["max"] - f["min"]) or 1.0
        return ((v - f["min"]) / width).alias(c)
    return df.select(*[one(c) for c in df.columns])


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x − mean) / population deviation; a constant column becomes 0, nulls stay."""
    return apply_scaler(df, fit_scaler(df, cols), "standard")


def minmax_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x − min) / (max − min); a constant column becomes 0."""
    return apply_scaler(df, fit_scaler(df, cols), "minmax")


def sanitize(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None,
             categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Invalid category → first valid one; infinities → null; clamp to range; null → median, else 0."""
    ranges, categories = ranges or {}, categories or {}

    def bounded(c: str) -> Column:
        if c in categories:
            return F.when(quoted(c).isin(categories[c]), quoted(c)).otherwise(F.lit(categories[c][0])).alias(c)
        if kind_of(df.schema[c].dataType) == NUMERIC and c in numeric:
            v = finite(quoted(c).cast("double"))
            return (clip(v, *map(float, ranges[c])) if c in ranges else v).alias(c)
        return quoted(c)

    numeric = [c for c in numeric_columns(df) if c not in categories]
    cleaned = df.select(*[bounded(c) for c in df.columns])
    medians = _numeric_fill(cleaned, numeric, "median") if numeric else {}
    return fill_missing(cleaned, {c: medians.get(c, 0.0) for c in numeric})


# -- steps as data -----------------------------------------------------------------

def _step_impute(df: DataFrame, cols: list[str], params: dict) -> DataFrame:
    return impute(df, [c for c in cols if c in df.columns], params.get("strategy", "mean"))


def _step_encode(df: DataFrame, cols: list[str], params: dict) -> DataFrame:
    for c in cols:
        if c in df.columns:
            df = one_hot(df, c) if params.get("method", "onehot") == "onehot" else label_encode(df, c)
    return df


def _step_scale(df: DataFrame, cols: list[str], params: dict) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    return (standard_scale if params.get("method", "standard") == "standard" else minmax_scale)(df, cols)


STEPS: dict[str, Callable[[DataFrame, list[str], dict], DataFrame]] = {
    "drop_column": lambda df, cols, params: drop_columns(df, cols),
    "impute": _step_impute,
    "drop_duplicates": lambda df, cols, params: df.dropDuplicates(),
    "encode": _step_encode,
    "scale": _step_scale,
    # names used by plain step lists
    "fill_na_median": lambda df, cols, params: fill_na_median(df),
    "fill_na_mode": lambda df, cols, params: fill_na_mode(df),
    "lowercase_strings": lambda df, cols, params: lowercase_strings(df),
}


def run_steps(df: DataFrame, steps: list[dict | str], on_unknown: Callable[[str], None] | None = None) -> DataFrame:
    """Folds a list of step specs ({type, target_columns, params} or just a name) over the frame.

    An unknown type is reported and passed over.
    """
    for step in steps:
        spec = {"type": step} if isinstance(step, str) else step
        apply = STEPS.get(spec["type"])
        if apply is None:
            (on_unknown or (lambda kind: print(f"unknown step type {kind}: skipped")))(spec["type"])
            continue
        df = df.transform(apply, spec.get("target_columns", []), spec.get("params", {}))
    return df


# -- fitted preprocessing ---------------------------------------------------------------

class Preprocessor:
    """Encode text → scale everything → median, then 0; optionally encodes the target.

    ``fit`` stores means, deviations and medians as numbers and the label codes as small
    DataFrames; ``transform`` is joins on the codes and one projection.
    """

    def __init__(self, target: str | None = None, scale: bool = True, null_token: str = "nan"):
        self.target, self.scale, self.null_token = target, scale, null_token

    def fit(self, df: DataFrame) -> Preprocessor:
        self.feature_order = [c for c in df.columns if c != self.target]
        features = df.select(*[quoted(c) for c in self.feature_order])
        self.encoders = {c: label_mapping(features, c, self.null_token) for c in categorical_columns(features)}
        encoded = self._encode(features)
        self.numeric = numeric_columns(encoded)
        self.scaler = fit_scaler(encoded, self.numeric) if self.scale else {}
        scaled = apply_scaler(encoded, self.scaler)
        self.fills = {c: 0.0 for c in self.numeric}
        self.fills.update(_numeric_fill(scaled, self.numeric, "median"))
        return self

    def _encode(self, df: DataFrame) -> DataFrame:
        for c, mapping in self.encoders.items():
            if c in df.columns:
                df = label_encode(df, c, self.null_token, mapping)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return fill_missing(apply_scaler(self._encode(df), self.scaler), self.fills)


def align_to_schema(df: DataFrame, feature_order: list[str], fill: float | None = None,
                    types: dict[str, str] | None = None) -> DataFrame:
    """Exactly the expected columns in order: absent ones as null (or ``fill``), others dropped."""
    types = types or {}
    return df.select(*[
        quoted(c) if c in df.columns else F.lit(fill).cast(types.get(c, "double")).alias(c) for c in feature_order])
